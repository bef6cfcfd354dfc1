"""Alignment of two tokenizers' tokens over the same texts.

Each text, with a space before it, is tokenised in full by a byte-level vocabulary (A) and by a piece vocabulary (B). Where the tokens of both have the bytes of the
text, places at which A and B both have a token that begins with a space are shared ends of what lies before; they cut the document into windows of
token ids. How the tokens in a window end together depends on its ids alone, so the alignment of a window is remembered by its two tuples of ids and each
different one is worked out once a task. Groups and links of a document are those of its windows in order: an end shared inside a window is found in it.

Links join tokens of which the shorter is a suffix of the longer, both ending at one byte. So however large the corpus, there are no more different pairs
than tokens of one vocabulary that are suffixes of tokens of the other (``pair_bound``; under half a million for the installed files). That table of corpus counts is
broadcast; the links of documents never meet in a shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import tokens
from tidemill.llm.tables import with_small_batches
from tidemill.llm.text import chunks
from tidemill.session import shared_folder

REMEMBERED = 200_000   # windows a task keeps; beyond that it starts anew
LONGEST = 32           # windows of more tokens are not kept
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabulary:
    """The bytes of all tokens in one buffer."""

    def __init__(self, found: list[bytes]):
        self.sizes = np.array([len(x) for x in found], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(found), np.uint8)
        self.spaced = np.array([x[:1] == b" " for x in found])

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The joined bytes of tokens."""
        sizes = self.sizes[ids]
        return self.data[np.arange(sizes.sum()) + np.repeat(self.begins[ids] - (np.cumsum(sizes) - sizes), sizes)]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of a token of ``a`` and one of ``b`` can end together: the shorter is a suffix of the longer."""
    of_a, of_b = Counter(x for x in a if x), Counter(x for x in b if x)
    return (sum(n * of_b[x[i:]] for x, n in of_a.items() for i in range(len(x)))
            + sum(n * of_a[x[i:]] for x, n in of_b.items() for i in range(1, len(x))))


class Aligner:
    """Alignment of windows by the sizes of their tokens, remembered by token ids.

    A window is a run of 32-bit numbers: how many ids of A it has, these, and those of B; its alignment the text of its groups, a sign after each, and its links (64-bit
    numbers: a id times 2**32 plus b id)."""

    def __init__(self, a: Vocabulary, b: Vocabulary, most: int = REMEMBERED):
        self.a, self.b, self.kept = a, b, tokens.Kept(most)
        self.numbers = Vocabulary([b"%d;" % i for i in range(max(len(a.sizes), len(b.sizes)))])

    def windows(self, keys: list[bytes]) -> list[tuple[bytes, bytes]]:
        """The alignment of each window, all of them different; those not remembered are worked out all together."""
        found = self.kept.find(keys)
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            cuts = [4 + 4 * int.from_bytes(keys[i][:4], "little") for i in new]
            for i, x in zip(new, self.align([(keys[i][4:cut], keys[i][cut:]) for i, cut in zip(new, cuts, strict=True)]), strict=True):
                found[i] = x
            self.kept.add((keys[i], found[i]) for i in new if len(keys[i]) <= 4 * LONGEST + 4)
        return found

    def align(self, keys: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        """Groups end where tokens of both end; windows lie one after another, each as many bytes long in A as in B."""
        x, y = (np.frombuffer(b"".join([k[i] for k in keys]), np.uint32) for i in (0, 1))
        ends_a, ends_b = np.cumsum(self.a.sizes[x]), np.cumsum(self.b.sizes[y])
        mark = np.zeros(int(ends_a[-1]) + 1, np.uint8)
        mark[ends_a] = 1
        mark[ends_b] += 2
        shared = np.flatnonzero(mark == 3)
        last_a, last_b = np.searchsorted(ends_a, shared), np.searchsorted(ends_b, shared)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        # Ids in the order of the text: of each group those of A, then those of B; a sign after each.
        place_a = np.arange(len(x)) + np.append(0, last_b + 1)[group_a]
        place_b = np.arange(len(y)) + (last_a + 1)[group_b]
        ids, sign = np.empty(len(x) + len(y), np.int64), np.full(len(x) + len(y), ord(","), np.uint8)
        ids[place_a], ids[place_b] = x, y
        sign[place_a[last_a]], sign[place_b[last_b]] = ord("|"), ord(";")
        text = self.numbers.spell(ids)
        after = np.cumsum(self.numbers.sizes[ids])
        text[after - 1] = sign
        links = (x[last_a].astype(np.int64) << 32 | y[last_b]).tobytes()
        # Where the windows end, in groups and in the text.
        closed = np.searchsorted(last_a, np.cumsum([len(k[0]) // 4 for k in keys]) - 1)
        cuts, groups = after[place_b[last_b[closed]]].tolist(), (8 * (closed + 1)).tolist()
        text = text.tobytes()
        return [(text[p:q - 1] + b";", links[r:s]) for p, q, r, s in zip([0, *cuts[:-1]], cuts, [0, *groups[:-1]], groups, strict=True)]


def spelled(vocabulary: Vocabulary, ids: np.ndarray, first: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows of the bytes their tokens spell exactly; the tokens of row i are ``first[i]`` to ``first[i + 1]``."""
    ends = np.concatenate([[0], np.cumsum(vocabulary.sizes[ids])])
    size = np.diff(offsets)
    same = np.diff(ends[first]) == size
    kept = vocabulary.spell(ids[np.repeat(same, np.diff(first))])
    row = np.repeat(np.flatnonzero(same), size[same])
    same[row[kept != data[np.repeat(same, size)]]] = False
    return same


def _rows(data, offsets, a, b, aligner):
    """n_a, n_b, n_groups, groups_sha256, links (pairs and how often) of each row of bytes, a space before each text."""
    ia, fa = tokens.encode_rows(a.memo, data, offsets, a.signs)
    ib, fb = tokens.encode_rows(b.memo, data, offsets)
    same = spelled(aligner.a, ia, fa, data, offsets) & spelled(aligner.b, ib, fb, data, offsets) & (np.diff(offsets) > 0)
    ia, ib = ia[np.repeat(same, np.diff(fa))], ib[np.repeat(same, np.diff(fb))]
    na, nb = np.diff(fa) * same, np.diff(fb) * same
    size = np.diff(offsets)[same]
    rows = np.cumsum(size) - size
    at_a, at_b = (np.cumsum(v.sizes[i]) - v.sizes[i] for v, i in ((aligner.a, ia), (aligner.b, ib)))
    mark = np.zeros(int(size.sum()) + 1, np.uint8)
    mark[at_a[aligner.a.spaced[ia]]] = 1
    mark[at_b[aligner.b.spaced[ib]]] += 2
    mark[rows] = 3
    anchors = np.flatnonzero(mark[:-1] == 3)
    wa, wb = (np.append(np.searchsorted(at, anchors), len(at)) for at in (at_a, at_b))
    windows = np.arange(len(anchors))
    begin = wa + wb + np.arange(len(anchors) + 1)  # a window's number of ids of A, these, and its ids of B
    flat = np.empty(begin[-1], np.uint32)
    flat[begin[:-1]] = np.diff(wa)
    flat[np.arange(len(ia)) + np.repeat(wb[:-1] + windows + 1, np.diff(wa))] = ia
    flat[np.arange(len(ib)) + np.repeat(wa[1:] + windows + 1, np.diff(wb))] = ib
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(anchors), [None, pa.py_buffer(4 * begin), pa.py_buffer(flat)]).dictionary_encode()
    found = aligner.windows(coded.dictionary.to_pylist())
    text, ends = tokens.gathered([x[0] for x in found], coded.indices)
    codes, linked = tokens.gathered([x[1] for x in found], coded.indices)
    codes = codes.view(np.int64)
    cuts = np.append(np.searchsorted(anchors, rows), len(anchors))
    ends, linked = ends[cuts].tolist(), (linked[cuts] // 8).tolist()
    groups, digests, links = np.zeros(len(same), np.int64), [""] * len(same), [b""] * len(same)
    for k, row in enumerate(np.flatnonzero(same).tolist()):
        digests[row] = hashlib.sha256(text[ends[k]:ends[k + 1] - 1]).hexdigest()
        groups[row] = linked[k + 1] - linked[k]
        mine, times = np.unique(codes[linked[k]:linked[k + 1]], return_counts=True)
        packed = np.empty(len(mine), LINK)
        packed["a"], packed["b"], packed["n"] = mine >> 32, mine & 0xFFFFFFFF, times
        links[row] = packed.tobytes()
    return na, nb, groups, digests, links


# A pair of ids and how often a document holds it linked.
LINK = np.dtype([("a", "<u4"), ("b", "<u4"), ("n", "<u4")])


def _spaced(column) -> pa.Array:
    """Texts with a space before them; null and empty ones stay empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    joined = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string()))
    return pc.if_else(pc.equal(pc.binary_length(column), 0), column, joined)


def _aligned(content, proto):
    def run(batches):
        a, b = tokens.byte_tokenizer(content.value, True), tokens.piece_tokenizer(proto.value)
        aligner = Aligner(Vocabulary(a.token_bytes()), Vocabulary(b.token_bytes()))
        for batch in batches:
            for low, high, data, offsets in chunks(_spaced(batch.column("text")), 1 << 21):
                with tokens.uncollected():
                    na, nb, groups, digests, links = _rows(data, offsets, a, b, aligner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[low:high], pa.array(na), pa.array(nb), pa.array(groups), pa.array(digests, pa.string()), pa.array(links, pa.binary())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
    return run


def _links(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), LINK)


def _counted(batches):
    """a, b, n of each run of documents."""
    for batch in batches:
        found = _links(batch.column(0))
        codes, group = np.unique(found["a"].astype(np.int64) << 32 | found["b"], return_inverse=True)
        n = np.bincount(group, weights=found["n"], minlength=len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes >> 32), pa.array(codes & 0xFFFFFFFF), pa.array(n)], names=["a", "b", "n"])


def _scored(shared):
    def run(batches):
        codes, counts, best = shared.value
        for batch in batches:
            column = batch.column("links")
            found = _links(column)
            row = np.repeat(np.arange(len(column)), np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)) // LINK.itemsize)
            at = np.searchsorted(codes, found["a"].astype(np.int64) << 32 | found["b"])
            n = found["n"].astype(np.int64)
            total = [np.bincount(row, minlength=len(column)) * 0 for _ in range(3)]
            for out, values in zip(total, (n, n * best[at] if len(at) else n, n * counts[at] if len(at) else n), strict=True):
                np.add.at(out, row, values)  # whole numbers, exact beyond 2**53
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *map(pa.array, total), batch.column("groups_sha256")],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    return run


def aligned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bytes_file: str = tokens.BYTES, pieces_file: str = tokens.PIECES) -> DataFrame:
    """One row per row of ``docs``, written once to the shared folder: doc_id, n_a, n_b, n_groups, groups_sha256, links (packed ``LINK`` entries)."""
    spark = docs.sparkSession
    with open(bytes_file, encoding="utf-8") as a, open(pieces_file, "rb") as b:
        content, proto = spark.sparkContext.broadcast(a.read()), spark.sparkContext.broadcast(b.read())
    path = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with with_small_batches(spark):
        source.mapInArrow(_aligned(content, proto), ALIGNED).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(ALIGNED).parquet(path)


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, n: how many links of the corpus hold a pair of ids linked."""
    return rows.select("links").mapInArrow(_counted, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bytes_file: str = tokens.BYTES, pieces_file: str = tokens.PIECES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link's count is how many links of the corpus hold its ids; it is best where no other id of A has a higher count with its B id. Texts that are null or empty,
    or whose tokens do not spell a space and the text, have no tokens: zeros and an empty digest. Strings of special tokens are ordinary text.
    Repeated rows and null ids are rows of their own, and their links count each time; an empty table gives an empty table; other columns are not read.
    """
    rows = aligned(docs, doc_id, text, bytes_file, pieces_file)
    found = pair_counts(rows).toArrow()
    a, b, n = (found.column(c).to_numpy() for c in ("a", "b", "n"))
    order = np.argsort(a << 32 | b)
    a, b, n = a[order], b[order], n[order]
    highest = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
    np.maximum.at(highest, b, n)
    shared = docs.sparkSession.sparkContext.broadcast((a << 32 | b, n, n == highest[b]))
    return rows.mapInArrow(_scored(shared), SCORED)
