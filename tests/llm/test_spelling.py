"""Spelling groups against brute force and their SQL twin, and blocks dealt into slices."""

import random
from collections import Counter

import oracle
import pytest

from tidemill.llm import queries, spelling

FOLDER = "/root/testdata/sf0.01"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    found = {}
    for w in words:
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= spelling.TIMES * words[w] else None
        found[w] = (form, words[w], len(around), words[form] if form else None)

    def root(w):
        return root(found[w][0]) if found[w][0] else w
    return {w: (f[0], root(w), *f[1:]) for w, f in found.items()}


def table(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.fixture(scope="module")
def crowded():
    """Words over few letters, many of them near each other, with repeated letters, long words and letters beyond ASCII."""
    pick, words = random.Random(3), {}
    for _ in range(400):
        words["".join(pick.choice("abé") for _ in range(pick.randrange(6, 9)))] = pick.choice([5, 6, 26, 40, 200, 1100])
    long = "".join(pick.choice("xyzÿ") for _ in range(700))
    return words | {long: 5, long[:-1]: 25, long[1:]: 130, "a" * 6: 5, "a" * 7: 25, "a" * 8: 125, "a" * 9: 700}


def docs(spark, words):
    # Altered words depend on the id; counted here as the library does, the words themselves are checked by SQL.
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(sorted(words.items()))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("most", [8192, 7, 100])
def test_near_words_of_crowded_blocks(spark, crowded, most):
    df = docs(spark, crowded)
    words = {r["word"]: r["n"] for r in spelling.word_counts(df).collect()}
    assert len(words) >= 0.9 * len(crowded)
    assert table(spelling.spelling_groups(df, most=most)) == brute(words)


def test_chain_of_forms(spark):
    words = spark.createDataFrame([("abcdef", 5), ("abcdeg", 25), ("abcdgg", 125), ("abcggg", 625)], "word string, n long")
    found = {r["word"]: (r["n_near"], r["near"], r["near_n"]) for r in spelling.near_words(words).collect()}
    assert found == {"abcdef": (1, "abcdeg", 25), "abcdeg": (2, "abcdgg", 125), "abcdgg": (2, "abcggg", 625), "abcggg": (1, "abcdgg", 125)}
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "f")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling._roots(forms).collect()} == dict.fromkeys("abcdex", "f")


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (None, "Straße " * 6), (3, "x" * 200_000), (3, "x" * 200_000), (4, "Élan Élan élan-vital " * 3), (5, "short " * 9 + "ß×÷ÿÀ" * 2 + " 日本語日本語 " * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 word", "2 n", "3 block", "4 near")
    assert {r["word"]: r["n"] for r in spelling.word_counts(df).collect()} == {"straße": 6}
    assert table(spelling.spelling_groups(df)) == {"straße": (None, "straße", 6, 0, None)}
    wide = {r["word"]: r["n"] for r in spelling.word_counts(df, least=1).collect()}
    assert wide["x" * 200_000] == 2 and "ß×÷ÿÀß×÷ÿÀ" in wide
    assert spelling.spelling_groups(df.limit(0)).collect() == []


def test_altered_words(spark):
    import zlib
    run = next(w for w in (f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}" for i in range(600)) if zlib.crc32(f"7:{w}".encode()) % 199 == 0)
    at = zlib.crc32(f"7:{run}".encode()) % len(run)
    df = spark.createDataFrame([(7, f"{run.upper()} " * 5), (8, f"{run} " * 3)], "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(df, least=1).collect()} == Counter({run[:at] + run[at + 1:]: 5, run: 3})


def test_sql(spark):
    oracle.same(queries.op11_spelling(spark, FOLDER), oracle.connect(FOLDER), queries.OP11_SQL)
