import pytest

from inkgrid.llm import langid as L

SEED = {
    "en": ["The captain walked to the old mill and waited.", "Do you remember what she said last night?", "We found the lantern behind the school.", "I can hear someone in the harbour."],
    "de": ["Der Kapitän ging zur alten Mühle und wartete.", "Weißt du noch, was sie gestern gesagt hat?", "Wir haben die Laterne hinter der Schule gefunden.", "Ich höre jemanden im Hafen."],
    "fr": ["Le capitaine est allé au vieux moulin.", "Te souviens-tu de ce qu'elle a dit hier soir ?", "Nous avons trouvé la lanterne derrière l'école.", "J'entends quelqu'un au port."],
    "es": ["El capitán fue al viejo molino y esperó.", "¿Recuerdas lo que dijo anoche?", "Encontramos la linterna detrás de la escuela.", "Oigo a alguien en el puerto."],
    "ru": ["Капитан пошёл к старой мельнице.", "Я слышу кого-то в гавани."],
    "ja": ["船長は古い水車小屋へ行った。", "港で誰かの声が聞こえる。"],
    "zh": ["船长去了旧磨坊。", "我听见有人在港口说话。"],
    "ko": ["선장은 낡은 방앗간으로 갔다."],
    "th": ["กัปตันไปที่โรงสีเก่า"],
}


@pytest.fixture(scope="module")
def bank():
    b = L.fit_models({k: v * 3 for k, v in SEED.items()})
    b.margin = 4.0
    return b


def test_probabilities_sum_to_at_most_one(bank):
    import numpy as np

    m = bank.families[1]
    ctx = "the "
    total = np.zeros(len(m.langs))
    for c in "abcdefghijklmnopqrstuvwxyz .,!?'äöüßéèêàçñ¿¡\n-":
        total += np.exp(m.score(np.array([10, *map(ord, ctx), ord(c)], np.uint32))[-1])
    assert (total <= 1.02).all() and total.max() > 0.5


@pytest.mark.parametrize("text,lang", [("We waited behind the old school.", "en"), ("Wir warten hinter der alten Schule.", "de"), ("Nous attendons derrière la vieille école.", "fr"), ("Esperamos detrás de la vieja escuela.", "es"), ("船長は港へ行った。", "ja"), ("선장은 갔다.", "ko")])
def test_language_of_sentences(bank, text, lang):
    d = L.decide(bank, [text])
    assert L.LANGS[d.whole[0]] == lang


def test_mixed_text_has_a_row_per_language(bank):
    text = "We found the lantern behind the school. 港で誰かの声が聞こえる。"
    d = L.decide(bank, [text])
    assert L.languages(d, 0) == ["en", "ja"]
    parts = L.joined_stretches(bank, d, 1)[0]
    assert [p[2] for p in parts] == ["en", "ja"] and parts[0][0] == 0 and parts[-1][1] == len(text)


def test_single_foreign_word_is_no_mix(bank):
    assert L.languages(L.decide(bank, ["OK、港で誰かの声が聞こえる。"]), 0) == ["ja"]


def test_lookalikes_and_wide_forms_read_as_plain():
    assert L.plain("Ｗe ﬁnd tһe lаntern") == "We find the lantern"
    assert L.plain("Капитан") == "Капитан"


def test_result_does_not_depend_on_the_batch(bank):
    a = "We found the lantern behind the school."
    one = L.decide(bank, [a])
    many = L.decide(bank, ["船長", "", "¡!", a, "x" * 5000])
    assert one.lead[one.text == 0].tolist() == many.lead[many.text == 3].tolist()


def test_codes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("EN",), ("en-US",), ("eng",), ("zh-Hans",), ("fr_FR",), ("??",), ("und",), ("",), (None,), (" deu ",), ("english",), ("xx",)], "label string")
    got = [r[0] for r in df.select(L.normal_code(F.col("label"))).collect()]
    assert got == ["en", "en", "en", "zh", "fr", None, None, None, None, "de", None, None]


REGIONS = "region_id long, page_id string, source_text string, translated_text string, source_lang string, translated_lang string, text string, label string, lang string, langs string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], REGIONS)


def test_wrong_labels_cover_nulls_repeats_and_extra_columns(spark, bank):
    b = spark.sparkContext.broadcast(bank)
    rows = [
        (1, "p", "港で誰かの声が聞こえる。", "I can hear someone in the harbour.", "ja", "EN"),
        (2, "p", "港で誰かの声が聞こえる。", "I can hear someone in the harbour.", "zh", None),
        (2, "p", "港で誰かの声が聞こえる。", "I can hear someone in the harbour.", "zh", None),
        (3, None, None, "", None, None),
        (4, "nowhere", "……", "123", None, "??"),
        (None, "q", "Ich höre jemanden im Hafen.", None, "de-DE", None),
        (5, "p", "船長は古い水車小屋へ行った。", "Le capitaine est allé au vieux moulin. 船長は古い水車小屋へ行った。", "jpn", "fr"),
    ]
    got = {tuple(r) for r in L.wrong_labels(frame(spark, rows), b).collect()}
    assert got == {(2, "source_text", "ja"), (2, "translated_text", "en"), (5, "translated_text", "fr"), (5, "translated_text", "ja")}


def test_an_unsure_text_keeps_a_label_of_its_script(spark, bank):
    b = spark.sparkContext.broadcast(bank)
    rows = [(1, "p", "", "Mune!", "ja", None), (2, "p", "", "Mune!", "ja", "en"), (3, "p", "", "Mune!", "ja", "es"), (4, "p", "", "Mune!", "ja", "ru")]
    got = {r["region_id"]: r["lang"] for r in L.wrong_labels(frame(spark, rows), b).collect()}
    assert set(got) == {1, 4} and set(got.values()) <= {"en", "de", "fr", "es"}


def test_empty_tables(spark, bank):
    b = spark.sparkContext.broadcast(bank)
    empty = frame(spark, [])
    assert L.wrong_labels(empty, b).count() == 0
    assert L.segment_languages(empty, b).count() == 0
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    bank2 = L.fit_on(L.training_sample(docs, empty))
    assert L.decide(bank2, ["hello there my friend"]).single.shape == (1,)


def test_very_long_text(bank):
    d = L.decide(bank, ["We found the lantern behind the school. " * 20000])
    assert L.languages(d, 0) == ["en"]


def test_training_sample_is_bounded_per_label(spark):
    docs = spark.createDataFrame([(i, "en", f"text {i}") for i in range(50)] + [(99, None, "x"), (98, "de", "")], "doc_id long, lang string, text string")
    assert L.training_sample(docs, None, per_label=7).count() == 7


def test_held_out_accuracy_on_the_tables(spark, data):
    from inkgrid.session import table

    docs = table(spark, data, "documents").where("length(text) > 60 and lang is not null").select("doc_id", "lang", "text")
    rows = [(r["lang"].lower()[:2], r["text"]) for r in docs.collect() if r["lang"].lower()[:2] in L.LANGS]
    train, held = rows[::2], rows[1::2]
    bank = L.fit_rows(sorted(train))
    d = L.decide(bank, [t for _, t in held])
    right = sum(L.LANGS[w] == lang for w, (lang, _) in zip(d.whole, held, strict=True))
    assert right / len(held) > 0.93  # some labels of the table are wrong


@pytest.fixture(scope="module")
def calibrated(spark):
    """Models fitted and calibrated on tables with enough held-out sentences in every language."""
    from inkgrid.session import table

    d = "/root/testdata/sf0.1"
    return L.fit_on(L.training_sample(table(spark, d, "documents"), table(spark, d, "regions")))


FOREIGN = {
    "Ukrainian": ["Вона знайшла стару мапу в саду вчора ввечері.", "Що ти робиш у моєму будинку посеред ночі?", "Ми їдемо до міста, бо там живе її сестра."],
    "Italian": ["Ieri sera abbiamo trovato la vecchia mappa nel giardino.", "Perché non mi hai detto la verità quando potevi?", "La ragazza ha perso il suo ombrello vicino alla chiesa."],
    "Dutch": ["Gisteren hebben we de oude kaart in de tuin gevonden.", "Ik weet niet waarom hij dat gedaan heeft, maar het is te laat.", "Het meisje heeft haar paraplu bij de kerk verloren."],
}


@pytest.mark.parametrize("name", FOREIGN)
def test_languages_without_a_model_are_rejected(calibrated, name):
    d = L.decide(calibrated, FOREIGN[name])
    assert not d.sure.any() and (d.whole == -1).sum() >= 2
    assert all(L.languages(d, i) == [] for i in range(3) if d.unknown[i])
    assert all(p[2] == L.NONE for p in L.joined_stretches(calibrated, d, 3)[0])


def test_limits_are_calibrated_for_every_language(calibrated):
    import numpy as np

    assert np.isfinite(calibrated.limits).all() and (calibrated.limits > 1).all() and (calibrated.limits < 13).all()
    # single-language scripts have models of their own
    d = L.decide(calibrated, ["Что ты делаешь в саду?", "선장은 낡은 방앗간으로 갔다."])
    assert [L.LANGS[i] for i in d.whole] == ["ru", "ko"] and (d.entropy[np.isfinite(d.entropy)] > 0).all()


def test_cries_are_no_foreign_sentences(calibrated):
    d = L.decide(calibrated, ["нет нет нет нет нет нет нет", "ああああああああああああ", "TROPF TROPF"])
    assert not d.foreign.any() and [L.LANGS[i] for i in d.whole[:2]] == ["ru", "ja"]


def test_a_bank_is_stored_and_read_again(calibrated, tmp_path):
    calibrated.save(str(tmp_path / "bank"))
    b = L.Bank.load(str(tmp_path / "bank"))
    t = ["We found the lantern behind the school.", "Мы нашли карту."]
    assert b.margin == calibrated.margin and L.decide(b, t).entropy.tolist() == L.decide(calibrated, t).entropy.tolist()


def test_foreign_texts_have_no_row(spark, calibrated):
    b = spark.sparkContext.broadcast(calibrated)
    rows = [(1, "p", FOREIGN["Ukrainian"][1], FOREIGN["Italian"][1], None, None), (2, "p", "港で誰かの声が聞こえる。", FOREIGN["Dutch"][1], "ja", "en")]
    assert L.wrong_labels(frame(spark, rows), b).count() == 0
    got = {(r["region_id"], r["field"]): r["lang"] for r in L.segment_languages(frame(spark, rows[:1]), b).collect()}
    assert set(got.values()) == {L.NONE}


def test_sample_is_the_rows_of_least_hash_whatever_the_threshold(spark, monkeypatch):
    from inkgrid.llm import sampling
    from pyspark.sql import functions as F

    df = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, "b").when(F.col("id") % 7 == 0, F.lit(None)).otherwise("a").alias("g"), F.concat(F.lit("t"), F.col("id") % 3).alias("text"))
    take = lambda: {r["id"] for r in sampling.least_hashed(df, "id", 20, ("g",)).collect()}
    few = take()
    monkeypatch.setattr(sampling, "OVER", 10**6)  # all rows pass
    assert few == take() and len(few) == 40
    assert sampling.least_hashed(df, "id", 20).count() == 20 and sampling.least_hashed(df, "id", 20, usable="text = 't1'").where("text <> 't1'").count() == 0
    assert sampling.least_hashed(df.where("false"), "id", 20, ("g",)).count() == sampling.least_hashed(df.where("false"), "id", 20).count() == 0
    assert sampling.least_hashed(df.where("id < 8"), "id", 20, ("g",)).count() == 7
