"""The other operators: against brute force, round trips, held-out labels, and odd tables."""

import io
import math
import random
import zipfile

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import decontaminate, exact_dedup, langid, lm, mixing, queries, quality, toxicity, warc

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"
ODD = [(1, None, None, None, None, None, None), (2, "", "en", "src1", 0, "a", None), (3, "  \n", None, "x", 3, None, "b"), (3, "  \n", None, "x", 3, None, "b"),
       (None, "Some words here and there.", "en", None, 1, None, None), (5, "word " * 60_000, "de", "src2", 1, None, None), (6, "x" * 300_000, "de", "src2", 1, None, None),
       (7, "Same text. " * 200, "en", "src1", 1, None, None), (8, "SAME text. " * 200, "en", "src1", 1, None, None), (8, "SAME text. " * 200, "en", "src1", 1, None, None)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, None, None), (7, 1, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


def test_exact_dedup(odd, none):
    found = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd).collect()}
    assert found == {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (None, None, 1, True), (5, 5, 1, True), (6, 6, 1, True), (7, 8, 3, False), (8, 8, 3, True)}
    kept = exact_dedup.keep_distinct(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 5, 6, 8]
    assert exact_dedup.exact_dedup(none).collect() == [] and exact_dedup.keep_distinct(none).collect() == []


def test_exact_dedup_sees_shared_identifiers(spark):
    chunks = spark.createDataFrame([("a",), ("b",), ("a",)], "chunk string")
    assert exact_dedup.verified(chunks) and not exact_dedup.verified(chunks, lambda c: F.length(c))


def test_mixing_spends_shortages_among_siblings(spark):
    rows = [(i, "a", "x", 10) for i in range(2)] + [(10 + i, "a", "y", 10) for i in range(50)] + [(100 + i, "b", "x", 10) for i in range(50)] + [(999, "b", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, d string, s string, n_tokens long")
    weights = {"d": F.lit(1), "s": F.lit(1)}
    leaves = mixing.budgets(df.groupBy("d", "s").agg(F.sum("n_tokens").alias("tokens")), ["d", "s"], weights, 400, 2)
    assert {(r["d"], r["s"]): r["leaf_budget"] for r in leaves.collect()} == {("a", "x"): 40, ("a", "y"): 160, ("b", "x"): 200, ("b", None): 0}
    taken = mixing.mix(df, ["d", "s"], weights, 400, 2).groupBy("d", "s").agg(F.sum(F.col("n_tokens") * F.col("epochs")).alias("t")).collect()
    assert {(r["d"], r["s"]): r["t"] for r in taken} == {("a", "x"): 40, ("a", "y"): 160, ("b", "x"): 200}
    assert mixing.mix(df.limit(0), ["d", "s"], weights, 400, 2).collect() == []


def test_warc_round_trip(spark, folder):
    rows = [(1, "http://a", "é" * 60), (2, None, "é" * 60), (3, "u", "é" * 60), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "x" * 3_000_000), (None, "u", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    warc.write_pages(pages, f"{folder}/w")
    found = {r["page_id"]: r for r in warc.read_packages(warc.packages(spark, f"{folder}/w")).collect()}
    assert {i: bytes(found[i]["payload"]).decode() for i in (1, 4, 5, 6, 7)} == {i: t or "" for i, _, t in rows if i in (1, 4, 5, 6, 7)}
    assert [found[i]["record_type"] for i in (2, 3, None)] == ["revisit"] * 3 and found[3]["refers_to"] == 1 and found[2]["url"] == ""
    assert warc.resolved(warc.read_packages(warc.write_pages(pages.limit(0)).select("path"))).collect() == []


def test_zip64_directory():
    class File(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)
    file = File()
    with zipfile.ZipFile(file, "w", zipfile.ZIP_STORED) as package:
        with package.open("archive/a.warc", "w", force_zip64=True) as member:
            member.write(b"hello")
        package.writestr("b", b"x" * 100, compress_type=zipfile.ZIP_DEFLATED)
        package.comment = b"a note"
    members = {m.name: m for m in warc.directory(file, len(file.getvalue()))}
    assert file.read_at(members["archive/a.warc"].size, warc.member_start(file, members["archive/a.warc"])) == b"hello"
    with pytest.raises(ValueError):
        warc.member_start(file, members["b"])


def test_decontamination_recall(spark, odd, none):
    pick = random.Random(5)
    vocabulary = ["".join(pick.choice("abcdefghij") for _ in range(4)) for _ in range(800)]
    items = [[pick.choice(vocabulary) for _ in range(pick.randrange(15, 60))] for _ in range(60)]
    rows = []
    for i, item in enumerate(items):
        words = list(item)
        for _ in range(int(0.1 * len(item))):
            words[pick.randrange(len(words))] = "zzz"
        rows.append((i, " ".join([pick.choice(vocabulary) for _ in range(40)] + words + [pick.choice(vocabulary) for _ in range(20)]).upper() + "!"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(900, None), (901, ""), (None, "a b")], "item_id long, text string")
    found = decontaminate.find_items(docs, benchmark).collect()
    assert sum(r["doc_id"] == r["item_id"] for r in found) >= 57 and all(r["doc_id"] == r["item_id"] and r["distance"] <= 0.2 * r["item_words"] for r in found)
    assert decontaminate.find_items(odd, benchmark).collect() == [] and decontaminate.find_items(none, benchmark).collect() == []
    assert decontaminate.keep_clean(odd, benchmark).count() == len(ODD) and decontaminate.find_items(docs, benchmark.limit(0)).collect() == []


@pytest.mark.parametrize("length", range(3, 16))
def test_decontamination_finds_short_items_by_any_edits(length):
    pick = random.Random(length)
    vocabulary = ["".join(pick.choice("abcdefghij") for _ in range(4)) for _ in range(2000)]
    items = [[pick.choice(vocabulary) for _ in range(length)] for _ in range(40)]
    index = decontaminate.build_index(list(range(40)), [" ".join(x) for x in items])
    rows, truth = [], []
    for i, item in enumerate(items):
        for first in range(length):
            words = list(item)
            for place in [first, *pick.sample(range(length), int(0.2 * length))][:int(0.2 * length)]:
                place = min(place, len(words) - 1)
                words[place:place + 1] = pick.choice([["zzz"], [], ["zzz", words[place]]])
            rows.append(" ".join([pick.choice(vocabulary) for _ in range(first % 3)] + words + [pick.choice(vocabulary) for _ in range(i % 3)]))
            truth.append(i)
    found = {(r[0], r[1]) for r in decontaminate._found(index, pa.array(rows), 0.2)}
    assert sum((k, i) in found for k, i in enumerate(truth)) >= (1 if length < 15 else 0.99) * len(truth)


def test_mixing_hands_on_what_leaves_without_weight_leave(spark):
    rows = [("a", "x", 100), ("a", None, 10_000), ("b", "x", 1000), ("b", "y", 1000), ("c", None, 5000)]
    leaves = spark.createDataFrame(rows, "d string, s string, tokens long")
    weights = {"d": F.lit(1), "s": F.length(F.coalesce("s", F.lit("")))}
    found = {(r["d"], r["s"]): r["leaf_budget"] for r in mixing.budgets(leaves, ["d", "s"], weights, 2000, 2).collect()}
    assert found == {("a", "x"): 200, ("a", None): 0, ("b", "x"): 900, ("b", "y"): 900, ("c", None): 0}


def test_lattice_sums_all_segmentations():
    with open(lm.VOCABULARY, "rb") as file:
        lattice = lm.Lattice(file.read(), {300: 50, 1000: 20}, 3)
    log_p = dict(zip(lattice.hashes.tolist(), lattice.logs.tolist(), strict=True))

    def total(raw):
        from tidemill.llm.text import hash_spans
        ways = [0.0] * (len(raw) + 1)
        ways[0] = 1.0
        for j in range(1, len(raw) + 1):
            ways[j] += ways[j - 1] * math.exp(lattice.single[raw[j - 1]])
            for k in range(2, j + 1):
                h = int(hash_spans(np.frombuffer(raw[j - k:j], np.uint8), np.array([0]), np.array([k]))[0])
                ways[j] += ways[j - k] * math.exp(log_p[h]) if h in log_p else 0
        return math.log(ways[-1])
    words = ["the", "über", "a", "日本", "zzqx1"]
    assert lattice.words(pa.array(words)) == pytest.approx([total((lm.HEAD + w).encode()) for w in words])


def test_lm_odd_tables(odd, none):
    found = lm.lm_scores(odd).collect()
    assert len(found) == len(ODD) and all(r["score"] <= 0 and math.isfinite(r["score"]) for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (1, 2, 3)} == {1} and lm.lm_scores(none).collect() == []


def test_labels_on_held_out_rows(spark):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id", "left").collect()}
    good = [r for r in queries.op10_quality(spark, FOLDER).collect() if r["held_out"] and truth[r["doc_id"]]["quality"] is not None]
    assert sum(r["predicted"] == truth[r["doc_id"]]["quality"] for r in good) >= 0.95 * len(good)
    lang = [r for r in queries.op9_language_id(spark, FOLDER).collect() if r["held_out"] and truth[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in lang) >= 0.95 * len(lang)
    toxic = [r for r in queries.op3_toxicity(spark, FOLDER).collect() if r["held_out"] and truth[r["doc_id"]]["toxic"] is not None]
    clean = [r for r in toxic if not truth[r["doc_id"]]["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_grammar_events():
    grammar = toxicity.Grammar({})
    events = lambda text: [e for e, _ in grammar.events(text)]
    assert events("you idiot") == ["I"] and events("what an idiot") == ["i"] and events("he is not stupid") == ["In"]
    assert events('she said "what an idiot"') [0].endswith("r") and events("i will kill you") == ["T"] and events("kill the lights") == []


def test_odd_tables_of_classifiers(odd, none, labels):
    for found, empty in ((toxicity.toxicity(odd, labels), toxicity.toxicity(none, labels)), (quality.quality(odd, labels), quality.quality(none, labels.limit(0)))):
        rows = found.collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows) and empty.collect() == []
    rows = {r["doc_id"]: r for r in langid.language_id(odd).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[5]["lang_pred"] in ("en", "de") and langid.language_id(none).collect() == []


def test_frozen_code_lengths():
    text = np.frombuffer(b"abab", np.uint8)
    model = langid.build(["x"], [np.unique(langid.grams(text, np.array([0, 4]), langid.ORDER), return_counts=True)])
    # After "ab" only "a" was seen, once: 1 / (1 + 1), one bit; "c" is paid by an escape in each context down to equal bytes.
    known = model.lengths(langid.grams(np.frombuffer(b"aba", np.uint8), np.array([0, 3]), langid.ORDER))[2, 0]
    other = model.lengths(langid.grams(np.frombuffer(b"abc", np.uint8), np.array([0, 3]), langid.ORDER))[2, 0]
    assert known == pytest.approx(1.0) and other == pytest.approx(1 + 1 + 1 + math.log2((4 + 2) / 2) + 8)


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder, size = "/root/testdata/sf0.001", docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() <= size
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.distinct(spark, odd, folder).count() == 6 and corpus_pipeline.mixed(spark, odd, folder).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    oracle.same(queries.QUERIES[name](spark, FOLDER), oracle.connect(FOLDER), queries.ORACLE[name])


def test_urls_with_braces_and_repeated_rows(spark, folder):
    long = "<p>" + "z" * 200
    rows = [(1, "http://a/{id}", long), (2, "http://a/{\"offset\": 1} {", "two"), (3, None, "three"), (4, " \n ", None), (1, "http://a/{id}", long), (5, "http://é/ü?q={}", long), (5, "other", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    found = warc.read_packages(warc.write_pages(pages, f"{folder}/w").select("path")).collect()
    assert sorted(repr((r["page_id"], r["url"], r["record_type"], r["refers_to"])) for r in found) == sorted(map(repr, [
        (1, "http://a/{id}", "response", None), (1, "http://a/{id}", "response", None), (2, "http://a/{\"offset\":1}{", "response", None), (3, "", "response", None),
        (4, "", "response", None), (5, "http://é/ü?q={}", "revisit", 1), (5, "other", "response", None)]))


@pytest.mark.parametrize("layout", ["by url", "texts", "gaps", "no names", "none"])
def test_packages_of_other_writers(spark, folder, layout):
    """Two members, one index sorted by URL, offsets as texts, lines that leave records out, no file names, no index."""
    import hashlib
    import json
    records, lines, members = [], [], {"archive/a.warc.gz": b"", "archive/b.warc.gz": b""}
    for i in range(40):
        name = f"archive/{'ab'[i % 2]}.warc.gz"
        payload = f"page {i} ".encode() * 30
        packed = warc._gzip(warc.record(i, f"http://h/{i * 7 % 40:02d}", payload, hashlib.sha256(payload).hexdigest(), None))
        kind = str if layout == "texts" else int
        about = {"url": f"http://h/{i}", "offset": kind(len(members[name])), "length": kind(len(packed)), "filename": name.partition("/")[2]}
        if layout == "no names":
            del about["filename"]
        lines.append(f"h,a)/{{{i * 7 % 40:02d}}} 20240101 " + json.dumps(about))
        members[name] += packed
        records.append((i, payload))
    if layout == "gaps":
        del lines[5]
    with zipfile.ZipFile(f"{folder}/other.zip", "w", zipfile.ZIP_STORED) as package:
        if layout != "none":
            package.writestr("indexes/all.cdxj", "\n".join(["!meta 1 {}", "broken", *sorted(lines)]))
        for name, data in members.items():
            package.writestr(name, data)
    found = warc.read_packages(spark.createDataFrame([(f"{folder}/other.zip",)], "path string")).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in found) == records


def test_stretches_follow_the_index():
    member = warc.Member("archive/x.warc.gz", 0, 0, 3 * warc.STRETCH)
    third = warc.STRETCH
    lines = [("x.warc.gz", 2 * third, third), ("x.warc.gz", 0, third), ("x.warc.gz", third, third), ("y.warc.gz", 5, 9)]
    assert warc.member_stretches(member, lines, False) == [(0, third), (third, third), (2 * third, third)]
    assert warc.member_stretches(member, lines[1:], False) == [(0, 3 * third)] and warc.member_stretches(member, [(None, 0, 3 * third)], True) == [(0, 3 * third)]


def test_decontamination_beyond_64_repetitions():
    pick = random.Random(9)
    vocabulary = ["".join(pick.choice("abcdefghij") for _ in range(4)) for _ in range(800)]
    items = [[pick.choice(vocabulary) for _ in range(30)] for _ in range(20)]
    index = decontaminate.build_index(list(range(20)), [" ".join(x) for x in items], repetitions=130)
    assert index.starts.shape[1] == 3 and all(index.starts[:, k].any() for k in range(3))
    late = decontaminate.build_index(list(range(20)), [" ".join(x) for x in items], repetitions=130)
    late.starts[:, 0] = 0  # only repetitions from 64 on
    rows = [" ".join(["zzz", *item, "yyy"]) for item in items]
    assert {(r[0], r[1]) for r in decontaminate._found(late, pa.array(rows), 0.2)} >= {(i, i) for i in range(18)}


def test_decontamination_against_exhaustive_search(spark):
    """Real texts: every find is one by exhaustive edit search, and every copy that search sees is found."""
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()][:80]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    index = decontaminate.build_index([i for i, _ in bench], [t for _, t in bench])
    numbered, words = {}, []
    for _, text in docs:
        hashes = decontaminate._word_hashes(*decontaminate_bytes(text))[0]
        words.append(np.array([numbered.setdefault(int(h), len(numbered) + 1) for h in hashes], np.int64))
    truth = set()
    for k, (item_id, text) in enumerate(bench):
        hashes = decontaminate._word_hashes(*decontaminate_bytes(text))[0]
        item = np.array([numbered.get(int(h), -1) for h in hashes], np.int64)
        for d, (doc_id, _) in enumerate(docs):
            if len(item) and len(words[d]) and np.isin(words[d], item).sum() >= 0.8 * len(item) and decontaminate.best_stretch(item, words[d])[0] <= int(0.2 * len(item)):
                truth.add((doc_id, item_id))
    found = {(docs[r[0]][0], int(index.item_ids[r[1]])) for r in decontaminate._found(index, pa.array([t for _, t in docs], pa.string()), 0.2)}
    assert found == truth


def decontaminate_bytes(text):
    from tidemill.llm.text import text_bytes
    return text_bytes(decontaminate._lower(pa.array([text], pa.string())))


def test_mixing_odd_rows(spark):
    """Null ids and levels, repeated rows, rows without tokens, ties at the cut, other columns with clashing names."""
    rows = [(None, "a", None, 10), (1, "a", "x", 10), (1, "a", "x", 10), (2, "a", "x", None), (3, "a", "x", 7), (3, "a", "x", 5), (4, None, "x", 10), (5, None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, d string, s string, n_tokens long").selectExpr("*", "1 _key", "2 leaf_budget", "3 _range", "4 epochs")
    weights = {"d": F.lit(1), "s": F.lit(1)}
    whole = mixing.mix(df, ["d", "s"], weights, 1000, 1)
    assert whole.columns == ["doc_id", "d", "s", "n_tokens", "epochs"]
    assert sorted(map(repr, ((r["doc_id"], r["d"], r["s"], r["n_tokens"], r["epochs"]) for r in whole.collect()))) == sorted(repr((i, d, s, n or 0, 1)) for i, d, s, n in rows if (d, s) != (None, None))
    for budget in (5, 20, 37):
        once, again = ([sorted(map(repr, map(tuple, mixing.mix(x, ["d", "s"], weights, budget, 1).collect()))) for x in (df, df.repartition(5))])
        assert once == again
        spent = mixing.mix(df, ["d", "s"], weights, budget, 1).agg(F.sum(F.col("n_tokens") * F.col("epochs"))).first()[0] or 0
        assert spent <= budget


def test_mixing_ranges_follow_the_leaf(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id doc_id", "'a' d", "if(id % 10 = 0, 'rare', 'big') s", "id % 7 + 1 n_tokens")
    weights = {"d": F.lit(1), "s": F.lit(1)}
    plain = sorted(map(tuple, mixing.mix(df, ["d", "s"], weights, 5000, 2).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    assert sorted(map(tuple, mixing.mix(df, ["d", "s"], weights, 5000, 2).collect())) == plain


def test_mixing_sql_on_sources_without_weight(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source")))
    odd.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    import duckdb
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    oracle.same(queries.op1_mixing(spark, folder), con, queries.ORACLE["op1_mixing"])


def test_lm_counts_against_brute_force(spark):
    import re
    import zlib
    from collections import Counter
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["\x00end"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total = sum(counts.values())
    below = total + 0.1 * (len(counts) + 1)
    for r in queries.op8_lm_scores(spark, "/root/testdata/sf0.001").collect():
        ws = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / below) for w in ws), rel=1e-9)


def test_expected_uses_sum_over_all_segmentations():
    """Uses of pieces by forward and backward recursion equal those counted segmentation by segmentation, and rounds of fitting raise the likelihood."""
    with open(lm.VOCABULARY, "rb") as file:
        proto = file.read()
    lattice = lm.Lattice(proto, {300: 50, 1000: 20}, 3)
    words, times = ["the", "übe", "a", "ther", "日", "zq"], np.array([3.0, 1.0, 7.0, 2.0, 5.0, 1.0])
    by_hash = {int(h): (int(i), float(p)) for h, i, p in zip(lattice.hashes, lattice.ids, lattice.logs, strict=True)}
    from tidemill.llm.text import hash_spans

    def splits(raw):
        if not raw:
            yield [], 0.0
        for k in range(1, len(raw) + 1):
            if k == 1:
                piece = (int(lattice.byte_ids[raw[0]]), float(lattice.single[raw[0]]))
            else:
                piece = by_hash.get(int(hash_spans(np.frombuffer(raw[:k], np.uint8), np.array([0]), np.array([k]))[0]))
            if piece:
                for ids, log in splits(raw[k:]):
                    yield [piece[0], *ids], piece[1] + log
    truth = np.zeros(lattice.size)
    for word, n in zip(words, times, strict=True):
        found = list(splits((lm.HEAD + word).encode()))
        whole = sum(math.exp(log) for _, log in found)
        for ids, log in found:
            for i in ids:
                truth[i] += n * math.exp(log) / whole
    assert lattice.expected(pa.array(words), times) == pytest.approx(truth)
    score = lambda x: float(x.words(pa.array(words)) @ times)
    rounds = [lm.Lattice(proto, {}, 3, prior=0.01)]
    for _ in range(4):
        uses = rounds[-1].expected(pa.array(words), times)
        rounds.append(lm.Lattice(proto, {int(i): float(uses[i]) for i in np.flatnonzero(uses)}, 3, prior=0.01))
    assert all(score(b) >= score(a) - 1e-6 for a, b in zip(rounds[1:-1], rounds[2:], strict=True)) and score(rounds[-1]) > score(rounds[0]) + 10


def test_expected_uses_do_not_depend_on_runs(monkeypatch):
    with open(lm.VOCABULARY, "rb") as file:
        lattice = lm.Lattice(file.read(), {}, 3)
    words = pa.array(["a", "", "word" * 40, "über", "x" * 3000, "the", "the"])
    times = np.arange(1.0, 8.0)
    whole = lattice.expected(words, times)
    monkeypatch.setattr(lm, "CELLS", 8)
    assert lattice.expected(words, times) == pytest.approx(whole)
    assert lattice.expected(pa.array([], pa.string()), np.zeros(0)).sum() == 0
