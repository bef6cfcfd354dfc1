"""Near duplicates against all pairs, with short lists and with every list long."""

import random
import re

import pytest

import tidemill.llm.near_dedup as module
from tidemill.llm.exact_dedup import keep_distinct
from tidemill.llm.near_dedup import keep_one_each, near_dedup

WORDS = [a + b for a in "ba de fi go lu mi na po ru sa".split() for b in "ban der fil gor lum mit nas por rut sal".split()]


def brute(rows, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in ids)


def corpus():
    pick = random.Random(3)
    text = lambda n: " ".join(pick.choice(WORDS) for _ in range(n))
    passage, rows = text(60), []
    base = text(120)
    for k in range(60):  # a family of near copies, at all distances around the threshold
        words = base.split()
        for _ in range(k % 5):
            words[pick.randrange(len(words))] = pick.choice(WORDS)
        rows.append(" ".join(words))
    for k in range(40):  # one passage with more or less around it
        rows.append(text(k % 12) + " " + passage + " " + text(k % 7))
    for k in range(40):  # the passage in long texts
        rows.append(text(100) + " " + passage + " " + text(40))
    for _ in range(20):  # small families
        one = text(80).split()
        for _ in range(3):
            words = list(one)
            words[pick.randrange(80)] = pick.choice(WORDS)
            rows.append(" ".join(words))
    rows += [base] * 5 + [base.upper(), "One two", "one TWO", "one two three", "", None, "   ", "x" * 200_000, "y " * 30_000]
    pick.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("limit", [48, 6, 1])
@pytest.mark.parametrize("percent", [85, 80])
def test_all_pairs(spark, limit, percent):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_dedup(df, percent=percent, limit=limit)
    assert sorted(map(tuple, found.collect())) == brute(rows, percent)


def drifting():
    """Families in which each copy is a link away from the next only, though all share most of a text; ids in any order."""
    pick = random.Random(8)
    rows = []
    for _ in range(12):
        words = [pick.choice(WORDS) for _ in range(120)]
        for k, place in enumerate(pick.sample(range(6, 114, 9), 9)):
            words[place] = f"new{k}"
            rows.append(" ".join(words))
    pick.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("limit", [6, 1])
def test_links_between_classes_linked_to_different_centres(spark, limit):
    rows = drifting()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near_dedup(df, limit=limit).collect())) == brute(rows, 85)


def test_odd_tables(spark):
    schema = "doc_id long, text string, kept string, n long"
    assert near_dedup(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (None, "a b c d e f", None, None), (None, None, None, None), (5, "z y x w v u", None, 2)]
    df = spark.createDataFrame(rows, schema)
    found = sorted((tuple(r) for r in near_dedup(df).collect()), key=str)
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True), (5, 2, 5, True)], key=str)
    kept = keep_one_each(df)
    assert kept.columns == df.columns


def test_rows_of_null_and_repeated_ids_stay_by_their_own_text(spark):
    a, b, c, d = "a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x"
    df = spark.createDataFrame([(None, a), (None, b), (5, a), (3, c), (3, d), (1, c), (6, None), (6, b + " y")], "doc_id long, text string")
    stay = [(1, c), (3, d), (5, a), (6, None), (6, b + " y"), (None, b)]
    assert sorted(map(tuple, keep_one_each(df).collect()), key=str) == sorted(stay, key=str)
    df = spark.createDataFrame([(None, a), (None, b), (5, a.upper()), (3, c), (3, d), (7, c), (2, ""), (8, None), (2, "x")], "doc_id long, text string")
    stay = [(None, b), (5, a.upper()), (3, d), (7, c), (8, None), (2, "x")]
    assert sorted(map(tuple, keep_distinct(df).collect()), key=str) == sorted(stay, key=str)


def test_unlinked_classes_of_one_long_list(spark, monkeypatch):
    """Texts around one shared passage, each a little under the threshold: no links, and few pairs measured beside the square of the list."""
    pick = random.Random(8)
    passage = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*passage, *(f"u{i}x{k}" for k in range(pick.randrange(40, 60)))])) for i in range(300)]
    near = [(1000 + i, " ".join([*passage, *(f"n{i}x{k}" for k in range(3))])) for i in range(100)]
    df = spark.createDataFrame(rows + near, "doc_id long, text string")
    measured = []
    real = module._Linker.measured
    monkeypatch.setattr(module._Linker, "measured", lambda self, pairs: measured.append(pairs.count()) or real(self, pairs))
    found = {x["doc_id"]: x["component_id"] for x in near_dedup(df, percent=80, limit=6).collect()}
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows + near}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert found == {i: root(i) for i in ids}
    assert sum(measured) < len(ids) ** 2 / 8


@pytest.mark.parametrize("percent", [80, 85])
def test_tables_between_steps_are_deleted(spark, percent):
    """One large family of near copies: what is left in the shared folder is little beside the texts."""
    import os
    pick = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1500):
        words = list(base)
        for _ in range(pick.randrange(0, 5)):
            words[pick.randrange(120)] = f"z{i}q{pick.randrange(9)}"
        rows.append((i, " ".join(words)))
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")

    def used():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared) if "scratch-" in d for f in names)
    before = used()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert near_dedup(df, percent=percent).count() == 1500
    assert used() - before < 3 * sum(len(t) for _, t in rows)
