"""Token alignment and token files against whole-text tokenisation, one text at a time."""

import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import alignment, queries, token_file, tokens
from tidemill.llm.text import chunks

FOLDER = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " "), (3, " "), (None, "null id and more words"), (None, None), (5, "word " * 60_000), (6, "x" * 100_000), (7, "a <|endoftext|> b</s>"),
       (8, "tabs\tand\nlines \n and  two   spaces "), (9, "▁marked ▁ words"), (10, "日本語 テキスト　全角 \u0085 x y 🙂"), (7, "a <|endoftext|> b</s>"), (11, "nul \x00 and \x1c sign")]


@pytest.fixture(scope="module")
def whole():
    with open(tokens.BYTES, encoding="utf-8") as a, open(tokens.PIECES, "rb") as b:
        content = a.read()
        return tokens.Bytes(content, True), tokens.Bytes(content, False), tokens.Pieces(b.read())


@pytest.fixture
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    return df.selectExpr("*", "'p' path", "1 tokens", "2 start", "3 part", "4 links", "5 n_a")


def pairs(text, a, b, table_a, table_b):
    """The groups of a text, walked end by end, and the pairs of ids that close them."""
    ia, ib = (a.model.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)) if text else ([], [])
    if not text or any(b"".join(table[i] for i in ids) != (" " + text).encode() for ids, table in ((ia, table_a), (ib, table_b))):
        return [], [], [], []
    groups, links, x, y = [], [], [], []
    ends_a, ends_b = (np.cumsum([len(t[i]) for i in ids]).tolist() for ids, t in ((ia, table_a), (ib, table_b)))
    i = j = 0
    while i < len(ia) or j < len(ib):
        if j == len(ib) or i < len(ia) and ends_a[i] <= ends_b[j]:
            x.append(ia[i])
            i += 1
        else:
            y.append(ib[j])
            j += 1
        if x and y and ends_a[i - 1] == ends_b[j - 1]:
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            links.append((x[-1], y[-1]))
            x, y = [], []
    return ia, ib, groups, links


def expected(rows, whole):
    a, _, b = whole
    table_a, table_b = a.token_bytes(), b.token_bytes()
    found = [(i, *pairs(t, a, b, table_a, table_b)) for i, t in rows]
    counts = Counter(link for x in found for link in x[4])
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return sorted(((i, len(ia), len(ib), len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else "") for i, ia, ib, groups, links in found), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect()), key=repr)


def test_alignment_of_documents(spark, whole):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert got(queries.op12_alignment(spark, FOLDER)) == expected(rows, whole)


def test_alignment_of_odd_texts(spark, odd, whole):
    assert got(alignment.align(odd)) == expected(ODD, whole)
    assert alignment.align(odd.limit(0)).collect() == []


def test_pair_counts_and_their_bound(spark, odd, whole):
    a, _, b = whole
    rows = alignment.pair_counts(alignment.aligned(odd))
    found = Counter({(r["a"], r["b"]): r["n"] for r in rows.collect()})
    table_a, table_b = a.token_bytes(), b.token_bytes()
    assert found == Counter(link for _, t in ODD for link in pairs(t, a, b, table_a, table_b)[3])
    assert all(table_a[x].endswith(table_b[y]) or table_b[y].endswith(table_a[x]) for x, y in found)
    assert alignment.pair_bound([b"ab", b"b", b""], [b"b", b"cab", b"b"]) == 6 and alignment.pair_bound(table_a, table_b) < 500_000


def test_units_give_the_ids_of_whole_texts(whole):
    pick = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "日", " ", "　", " ", "'s", "12", "!", "<|endoftext|>", "<s>", "\x1c", "\x85", "\xa0", "word", "\x00", "🙂", "ﬁ", "Ā"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(25))) for _ in range(3000)]
    plain, special, pieces = whole
    for low, high, data, offsets in chunks(alignment._spaced(pa.array(texts)), 1 << 14):
        for model, signs, ask in ((plain, plain.signs, lambda t: plain.model.encode(" " + t, add_special_tokens=False).ids), (pieces, None, pieces.model.encode)):
            ids, first = tokens.encode_rows(model.memo, data, offsets, signs)
            assert [ids[p:q].tolist() for p, q in zip(first[:-1], first[1:], strict=True)] == [ask(t) if t else [] for t in texts[low:high]]
    for low, high, data, offsets in chunks(pa.array(texts), 1 << 14):
        ids, first = tokens.encode_rows(special.memo, data, offsets, special.signs)
        assert [ids[p:q].tolist() for p, q in zip(first[:-1], first[1:], strict=True)] == [special.model.encode(t, add_special_tokens=False).ids for t in texts[low:high]]


def test_memo_starts_anew():
    asked = []
    memo = tokens.Memo(lambda texts: [asked.append(t) or [len(t)] for t in texts], most=2)
    for _ in range(2):
        assert memo.ids(["a", "bb", "ccc"], np.array([0, 1, 0, 2]))[0].tolist() == [1, 2, 1, 3]
    assert len(memo.kept) == 2 and len(asked) == 6


class File(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


@pytest.mark.parametrize("seed", range(4))
def test_every_id_is_read_directly(seed):
    pick = np.random.default_rng(seed)
    ids = (pick.integers(0, 1 << 32, 5000, dtype=np.uint64) >> pick.integers(0, 33, 5000).astype(np.uint64)).astype(np.uint32) if seed else np.zeros(600, np.uint32)
    starts = np.unique(np.concatenate([[0, len(ids)], pick.integers(0, len(ids), 40)]))
    docs = pa.array([None, *range(len(starts) - 2)], pa.int64())
    file = token_file.TokenFile(File(token_file.encode(docs, starts, ids)))
    assert [file.token(i) for i in range(len(ids))] == ids.tolist()
    for low, high in pick.integers(0, len(ids) + 1, (200, 2)):
        assert file.ids(low, high).tolist() == ids[low:high].tolist()
    assert [file.document(k).tolist() for k in range(len(docs))] == [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert file.document_table(0, len(docs))[0].equals(docs)
    with pytest.raises(IndexError):
        file.token(len(ids))


def test_widths_are_the_smallest():
    def size(plan, lengths):
        at, total = 0, 0
        for k, w in enumerate(plan):
            total += (sum(lengths) if not at else sum(lengths[at + 1:])) * (w + (k + 1 < len(plan)))
            at += w
        return total

    def splits(n):
        return [[n]] + [[w, *rest] for w in range(1, n) for rest in splits(n - w)]
    for seed in range(5):
        lengths = np.zeros(33, int)
        lengths[:9] = np.random.default_rng(seed).integers(0, 1000, 9)
        assert size(token_file.widths(lengths), lengths.tolist()) == min(size(p, lengths.tolist()) for p in splits(8))
    assert token_file.widths(np.zeros(33, int)) == [1]


def documents(rows, model):
    at = 0
    for i, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, token_file.END]
        yield i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids
        at += len(ids)


def test_files_of_documents(spark, whole):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    assert sorted(tuple(r) for r in queries.op13_token_file(spark, FOLDER).collect()) == [x[:4] for x in documents(rows, whole[1].model)]


def test_files_of_odd_texts(spark, odd, whole, folder):
    manifest = token_file.write_tokens(odd, f"{folder}/t", file_tokens=1000, piece_tokens=300)
    found = sorted((tuple(r) for r in token_file.read_documents(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, None, 1, 2, 3, 3, 5, 6, 7, 7, 8, 9, 10, 11]
    texts = dict(ODD)
    nulls = [None, "null id and more words"] if found[0][2] == 1 else ["null id and more words", None]
    order = [*((None, t) for t in nulls), *((r[0], texts[r[0]]) for r in found[2:])]
    truth = list(documents(order, whole[1].model))
    assert found == [x[:4] for x in truth] and manifest.count() >= 3
    everything = [i for x in truth for i in x[4]]
    places = [0, 1, 5, 999, 1000, len(everything) - 1, len(everything), -1, *range(2000, 60_000, 997)]
    looked = token_file.tokens_of(manifest, spark.createDataFrame([(p,) for p in places], "position long"))
    assert {r["position"]: r["id"] for r in looked.collect()} == {p: everything[p] for p in places if 0 <= p < len(everything)}
    assert token_file.read_documents(token_file.write_tokens(odd.limit(0))).collect() == []


def test_memo_keeps_what_is_asked_for_again():
    asked = []
    memo = tokens.Memo(lambda texts: [asked.append(t) or [len(t)] for t in texts], most=4)
    for rare in ("bb", "ccc", "dddd", "eeeee", "ffffff"):
        assert memo.ids(["a", rare], pa.array([1, 0, 1]))[0].tolist() == [len(rare), 1, len(rare)]
    assert asked.count("a") == 1 and len(asked) == 6 and len(memo.kept) <= 4


def test_codes_of_every_width():
    pick = np.random.default_rng(1)
    for width in range(1, 33):
        values = pick.integers(0, 1 << width, 1003, dtype=np.uint64).astype(np.uint32)
        data = token_file.pack(values, width)
        assert int.from_bytes(data, "little") == sum(int(v) << i * width for i, v in enumerate(values)) and len(data) == (1003 * width + 7) // 8
        for low, n in ((0, 1003), (3, 17), (8, 8), (1002, 1), (5, 0)):
            first = low * width // 8
            assert (token_file.unpack(data[first:((low + n) * width + 7) // 8], low * width - 8 * first, n, width) == values[low:low + n]).all()
        assert token_file.bit_lengths(values).tolist() == np.bincount([int(v).bit_length() for v in values], minlength=33).tolist()


def test_a_window_is_looked_up_once_a_chunk(whole, monkeypatch):
    """A text of equal words has few different windows, however many words it has."""
    plain, _, pieces = whole
    aligner = alignment.Aligner(alignment.Vocabulary(plain.token_bytes()), alignment.Vocabulary(pieces.token_bytes()))
    looked, windows = [], aligner.windows
    monkeypatch.setattr(aligner, "windows", lambda keys: looked.extend(keys) or windows(keys))
    _, _, data, offsets = next(iter(chunks(alignment._spaced(pa.array(["the same words " * 500] * 20)), 1 << 20)))
    na = alignment._rows(data, offsets, plain, pieces, aligner)[0]
    assert na.sum() > 20_000 and len(looked) < 20
