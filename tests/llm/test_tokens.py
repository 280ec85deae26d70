import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkgrid.llm import bpe, mixing as M

PATH = bpe.default_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no public tokenizer files here")


@pytest.fixture(scope="module")
def own():
    return bpe.automaton(PATH)


@pytest.fixture(scope="module")
def ref():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(s=st.text(max_size=60))
def test_any_text_as_the_library_does(own, ref, s):
    s = s.encode("utf-8", "replace").decode()
    assert own.encode(s) == ref(s)
    assert own.decode(own.encode(s)) == s


@settings(max_examples=300, deadline=None)
@given(s=st.text(alphabet="aabcdehinorst ", max_size=80))
def test_words(own, ref, s):
    assert own.encode(s) == ref(s)


@pytest.mark.parametrize("s", ["a" * 500, " " * 300 + "x", "<|endoftext|>", "日本語の文章" * 50, "🏮☂️" * 20, "aaaab" * 99, "\n\n \t\r\n", "don't we'll I'VE"])
def test_hard_cases(own, ref, s):
    assert own.encode(s) == ref(s) and own.decode(own.encode(s)) == s


def test_accepted_sequences_are_exactly_the_encodings(own):
    ids = own.encode(" strawberry")
    assert all(own.step(a, b) for a, b in zip(ids, ids[1:], strict=False))
    split = [own.whole[bytes([b])] for b in b" straw"]
    assert not all(own.step(a, b) for a, b in zip(split, split[1:], strict=False))


DOCS = "doc_id long, text string, source string, lang string, tokens string, ids string, cls string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "en", "t", "i", "c") for r in rows], DOCS)


def test_ids_for_null_empty_blank_and_repeats(spark, ref):
    df = docs(spark, [(1, None, "a"), (2, "", "a"), (3, "  \n", None), (4, "Hello there", "a"), (4, "Hello there", "a")])
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.token_ids(df).collect())
    assert got == [(1, []), (2, []), (3, ref("  \n")), (4, ref("Hello there")), (4, ref("Hello there"))]
    assert bpe.token_ids(df.where("false")).count() == 0


TARGETS = "source string, target_share double, max_repeats int"


def test_unreachable(spark):
    df = docs(spark, [(1, "word " * 10, "big"), (2, "word " * 2, "small"), (3, "word " * 8, None), (4, "word " * 5, "untargeted"), (5, None, "big")])
    t = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 2), ("none", 0.1, 9), ("small", 0.4, 2)], TARGETS)
    assert {r[0] for r in M.unreachable(df, t).collect()} == {"small", "none"}
    assert M.unreachable(df.where("false"), t).count() == 0  # nothing is asked of nothing
    assert M.unreachable(df, t.where("false")).count() == 0


def test_mixture_meets_targets_and_caps(spark):
    rows = [(i, "word " * (1 + i % 17), "a" if i % 3 else "b") for i in range(3000)] + [(9000 + i, None, "a") for i in range(5)]
    t = spark.createDataFrame([("a", 0.25, 2), ("b", 0.45, 3), ("c", 0.3, 2)], TARGETS)
    df = docs(spark, rows)
    got = M.mixture(df, t).collect()
    assert len(got) == 3005
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append((r["tokens"], r["uses"]))
        assert 0 <= r["uses"] <= 3
    total = sum(n for v in by.values() for n, _ in v)
    for s, share in (("a", 0.25), ("b", 0.45)):
        assert abs(sum(n * u for n, u in by[s]) / total - share) < 0.01
    assert all(u == 0 for n, u in by["a"] if n == 0)
    again = {(r["doc_id"], r["uses"]) for r in M.mixture(df.repartition(7), t).collect()}
    assert again == {(r["doc_id"], r["uses"]) for r in got}
    sh = {r["source"]: r for r in M.actual_shares(df, t).collect()}
    assert sh["c"]["tokens_used"] == 0 and abs(sh["b"]["actual_share"] - 0.45) < 0.01


def test_copies_sum_to_the_target():
    classes = [(1, 10, 10), (4, 20, 240), (6, 5, 300), (0, 3, 0)]
    for target in (0, 50, 300, 700, 1649, 5000):
        c = M.solve_copies(classes, target, 3, lean=0.1)
        got = sum(c[k] * t for k, _n, t in classes)
        assert abs(got - min(target, 3 * 550)) < 1e-6 and c[0] == 0.0 and max(c.values()) <= 3


def test_inclusion_is_about_the_expected_copies(spark):
    df = docs(spark, [(i, "word " * 4, "a") for i in range(4000)])
    t = spark.createDataFrame([("a", 0.4, 1)], TARGETS)
    for seed in (1, 2):
        uses = [r["uses"] for r in M.mixture(df, t, seed=seed).collect()]
        assert sum(uses) == 1600


def test_plan_agrees_with_plain_sums(spark):
    """The sources that the plan finds short are those whose capped tokens are less than the target, found by sums."""
    rows = [(i, "word " * (1 + i % 23), "abcde"[i % 5] if i % 4 else "a") for i in range(800)]
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.2, 1), ("c", 0.15, 1), ("d", 0.25, 2), ("e", 0.05, 3), ("f", 0.0, 1), ("g", 0.05, None)], TARGETS)
    counts = bpe.token_counts(docs(spark, rows)).collect()
    total = sum(r["tokens"] for r in counts)
    want = {r["source"] for r in t.collect() if (r["max_repeats"] or 0) * sum(x["tokens"] for x in counts if x["source"] == r["source"]) < r["target_share"] * total}
    assert {r[0] for r in M.unreachable(docs(spark, rows), t).collect()} == want and {"g"} < want


@pytest.mark.parametrize("lean", [0.0, 0.1])
def test_a_source_misses_its_target_by_half_a_document_at_most(spark, lean):
    rows = [(i, "word " * (1 + (i * 37) % 61), "ab"[i % 2]) for i in range(500)]
    t = spark.createDataFrame([("a", 0.33, 1), ("b", 0.61, 3)], TARGETS)
    counts = {r["doc_id"]: r["tokens"] for r in bpe.token_counts(docs(spark, rows)).collect()}
    for r in M.actual_shares(docs(spark, rows), t, lean=lean).collect():
        assert abs(r["tokens_used"] - r["target_share"] * sum(counts.values())) <= max(counts.values()) / 2 + 1
