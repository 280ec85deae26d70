import time

import pytest

from inkgrid.llm import sentences as S

CASES = {
    "en": ["Dr. Riso measured 32.9 cm on p. 37.", "Version 1.51.1 of the script names Raze vs. Dora.", "The scan (ca. 14.9 MB!) was lost last night.", "I... I think Ridone is right.", '"What a strange light!" said Rori quietly.', '"Is Kero still alive?" Kumu asked.', '"We found it," said Mumi, "and that is all."', '"I promised. What a light! Who is it? Run! Go! Now! Again!" whispered Gitari.', "We waited until 5 a.m.", "We met at 11 p.m. and left early.", "K. Yatato drew 11 panels, e.g. the scene.", "See vol. 26, no. 5, for the sketch.", "What a light!!", '"Standing alone."'],
    "de": ["Am 4. Mai kam Lusese zurück.", "Hr. Zeta zeichnete u. a. die Szene.", "„Was für ein Licht!“, sagte Lugimu leise.", "Ich … ich glaube, er hat recht.", "Dr. Moku hat auf S. 34 genau 20,8 cm gemessen.", "In Bd. 12 steht z. B. eine Skizze."],
    "fr": ["Le vol. 6 montre p. ex. une esquisse.", "« Cours, ils attendent ! » dit Muraya.", "M. Rona a mesuré 37,5 cm à la p. 8.", "Je... je crois que oui.", "Quelle étrange lumière !"],
    "es": ["El Sr. Seneso midió 16,5 cm en la pág. 44.", "—¿Sigue Baya con vida? —preguntó Nimi.", "«¡Qué luz tan extraña!», dijo Nineso.", "¡Corre!", "Yo... yo creo que sí."],
    "ru": ["В 57 г. до н. э. здесь стояла башня.", "«Беги, Мурита!» — тихо говорит Купета.", "Рисунок см. в т. 11, стр. 48.", "Я... я думаю, да."],
    "ja": ["「逃げろ、やつらが待っている！」と叫んだのはリドだった。", "えっ！？とニゼトが振り返った。", "あの……ネミの言うとおりだ。", "縮尺は3.4倍、p.51を参照。", "『港で声が聞こえる。』という題の手紙が見つかった。", "「港で声が聞こえる。」", "Dr.ラモが第16話の原稿を直した。"],
    "zh": ["“鲁泽还活着吗？”拉尼娜问。", "《巴巴，快跑！》这本书丢了。", "我……我觉得说得对。", "比例是21.4倍，见p.60。", "“我们找到了花盒。”"],
    "ko": ['"왜 숨겼어?" 하고 모기페가 물었다.', '"뛰어!"라고 라나가 작게 말했다.', "나... 나는 옳다고 생각해.", "배율은 32.3배이고 p. 56에 있다.", "정원에서 이런 빛은 처음 봐!"],
    "th": ["เราพบแผนที่ตอน 2.30 น. ใต้ภูเขา", "ดร. มูเปวัดได้ 33.3 ซม. พอดี", "ไฟล์ page_43.png มีขนาด 28.3 MB พอดี", "แสงในป่าแปลกจริงๆ"],
}


def cut(text):
    out, a = [], 0
    for e in S.sentence_ends(text):
        out.append(text[a:e].strip())
        a = e
    return out


@pytest.mark.parametrize("lang", CASES)
def test_single_sentences_stay_whole(lang):
    for s in CASES[lang]:
        assert cut(s) == [s]


@pytest.mark.parametrize("lang", CASES)
def test_round_trip_of_joined_sentences(lang):
    gap = "" if lang in ("ja", "zh") else " "
    sents = CASES[lang]
    for k in range(len(sents)):
        order = sents[k:] + sents[:k]
        assert cut(gap.join(order)) == order


def test_line_breaks_and_headings():
    assert cut("Chapter 3\n\nWe found\nthe map. Run!\n \n　\nEnd") == ["Chapter 3", "We found\nthe map.", "Run!", "End"]
    assert cut("Is it alive?They left. K. Mo drew it.The end") == ["Is it alive?", "They left.", "K. Mo drew it.", "The end"]


@pytest.mark.parametrize("t", [None, "", "   ", "\n\n", "　 "])
def test_nothing(t):
    assert S.sentence_ends(t) == []


def test_ends_count_code_points():
    assert S.sentence_ends("🏮 Run! 𠮷 stop.") == [6, 14]


def test_very_long_texts():
    assert len(S.sentence_ends("We found the map. " * 20000)) == 20000
    assert len(S.sentence_ends('"' + "We found the map. " * 20000)) == 20000
    assert len(S.sentence_ends('"' + "We found the map. " * 20000 + '"')) == 1
    assert S.sentence_ends("a" * 500000) == [500000]
    assert len(S.sentence_ends("e.g. " * 20000)) >= 1


def test_operator(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 5), (1, "A b. C d.", 5), (2, None, 1), (3, "", 1), (None, "X y.", 1)], "doc_id long, text string, end_pos int")
    assert sorted((r[0] or 0, r[1]) for r in S.sentence_table(df).collect()) == [(0, 4), (1, 4), (1, 9)]
    assert S.sentence_table(df.where("false")).count() == 0 and S.sentence_units(df.where("false")).count() == 0
    u = S.sentence_units(df.where("doc_id = 1").distinct()).orderBy("n").collect()
    assert [(r["n"], r["start_pos"], r["end_pos"], r["sentence"]) for r in u] == [(1, 0, 4, "A b."), (2, 5, 9, "C d.")]


# What each place by itself decides wrongly: its words allow an end, but what it would leave is no sentence.
JOINT = [
    ["It began at 5 p.m. Monday."],
    ["They came from the harbor at 5 a.m. Sunday.", "Nobody saw them."],
    ["She works for Lumo Inc. Berlin."],
    ["Well... Maybe... Yes, I think so."],
    ["We met at 11 p.m.", "Then we left the old mill by the river."],
    ["He sold lamps, maps, bells etc.", "Then he left for the harbor."],
    ["Call Lumo Ltd.", "Tomorrow we sail to the island."],
    ["We counted oars, nets, ropes etc. Monday.", "Run!", "Go!"],
]


@pytest.fixture(scope="module")
def fitted(spark):
    from inkgrid.session import table

    return S.fit(table(spark, "/root/testdata/sf0.1", "documents"))


def test_the_program_decides_better_than_each_place_alone(fitted):
    for model in (S.DEFAULT, fitted):
        right = {"program": 0, "greedy": 0}
        for sents in JOINT:
            t = " ".join(sents)
            want = [len(" ".join(sents[: k + 1])) for k in range(len(sents))]
            right["program"] += S.paragraph_ends(t, 0, len(t), model) == want
            right["greedy"] += S.greedy_ends(t, 0, len(t), model) == want
        assert right["program"] >= 7 and right["greedy"] <= 3, right


def test_single_sentences_stay_whole_with_the_fitted_model(fitted):
    for sents in CASES.values():
        for s in sents:
            assert S.sentence_ends(s, fitted) == [len(s)]


def test_fitted_words(fitted):
    assert fitted.closes["vol"] < 0 and fitted.opens["Nobody"] > 0 and all(abs(x) <= 1 for x in [*fitted.opens.values(), *fitted.closes.values()])
    assert S.fit_texts([]).lengths == S.DEFAULT.lengths


def test_every_document_enters_the_fit(spark):
    texts = [f"We saw Runa by the old mill {n}. Runa left for vol. {n} of the maps." for n in range(2500)]
    texts += ["Zeta came home. " * 2000, None, "", " "]  # the only text with this word is a long one
    model = S.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    assert model == S.fit_texts([t for t in texts if t]) and model.opens["Zeta"] == 1.0
    assert S.fit(spark.createDataFrame([], "doc_id long, text string")) == S.DEFAULT


def test_a_word_of_one_late_document_counts(spark):
    rows = [(n, "They left.") for n in range(6000)]
    for late in (0, 3000, 5999):  # wherever it stands
        some = [(i, "Kumo stayed. " * 5 if i == late else t) for i, t in rows]
        assert S.fit(spark.createDataFrame(some, "doc_id long, text string")).opens["Kumo"] == 1.0


def test_parts_add_up():
    texts = [s for sents in CASES.values() for s in sents] * 3
    total = {}
    for part in S.partial_counts(texts, 4):
        for k, (a, b) in part.items():
            total[k] = (total.get(k, (0, 0))[0] + a, total.get(k, (0, 0))[1] + b)
    assert S.model_of((*k, *n) for k, n in total.items()) == S.fit_texts(texts) and len(list(S.partial_counts(texts, 4))) > 10


@pytest.mark.parametrize("unit", ["and then the captain went out... Nobody moved ", '"We found it. ', "„«(", "He met K. Mo etc. and so on "])
def test_linear_in_the_length_of_a_paragraph(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.process_time()
    assert S.sentence_ends(text)[-1] == len(text.rstrip())
    assert time.process_time() - began < 5


def brute(text, model):
    """The best sum over all choices of places, tried one by one."""
    import itertools

    places = S._places(text, 0, len(text), model)
    starts, length = [0, *(p.next for p in places)], model.lengths[S.script_of(text, 0, len(text))]
    best = None
    for k in range(len(places)):
        for inner in itertools.combinations(range(len(places) - 1), k):
            total, i = 0.0, 0
            for j in [*inner, len(places) - 1]:
                a, p = starts[i], places[j]
                total += p.score - S.UNBALANCED * p.inside
                if i:
                    total += S._open_score(text, a, len(text), model) - S.UNBALANCED * places[i - 1].inside
                if not S._has_letters(text, a, places[i].end):
                    total -= 8.0
                n = p.end - a
                total += length[n] if n < S.LONG else -S.TAIL * (n - S.LONG)
                i = j + 1
            if best is None or total > best[0] + 1e-9:
                best = total, [places[j].end for j in [*inner, len(places) - 1]]
    return best[1]


@pytest.mark.parametrize("text", ["It began at 5 p.m. Monday. Run... Go etc. Now.", '"Run! Go!" he said. Wait... K. Mo etc. Left. "No.', "Wo... Da... Er kam am 4. Mai. Hr. Mo ging.", "word " * 90 + "a.m. Then etc. Then. " + "word " * 90 + "p.m. Go. Run."])
def test_program_against_all_choices(text):
    text = text.strip()
    assert S.paragraph_ends(text, 0, len(text), S.DEFAULT) == brute(text, S.DEFAULT)
