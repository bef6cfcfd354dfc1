"""Token ids of documents in binary files of directly addressable codes.

An id is split into chunks of bits, the lowest first. The first chunks of all ids lie one after another in level 0, the second chunks of those that need one in level 1,
and so on. A bitmap for each level says which ids go on, and a directory holds the number of ones before each block of ``BLOCK`` bits: id number i goes on in the
next level at the rank of i. So any id, and any run of ids, is read from a few byte ranges, without decoding what lies before it. The chunk widths of a file are
those that make it smallest, found from the counts of its ids by their lengths in bits.

A file (``.dac``, little endian): ``HEAD``; a ``LEVEL`` entry for each level; ids of documents (int64), their null marks (a byte each), their first tokens (uint64, one
more than documents); then for each level codes, bitmap, and directory. Documents come in ascending order of id over all files: files are numbered by partition
and by their place in it. Tasks write under a name of their own and move the whole file to its place, so a task that runs again leaves the same file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import tokens
from tidemill.llm.tables import with_small_batches
from tidemill.llm.text import chunks
from tidemill.session import materialise, shared_folder
from tidemill.sources.paths import open_path

END = 2
BLOCK = 512
FILE_TOKENS = 1 << 23    # a file is closed when it holds so many; a longer document has a file of its own
PIECE_TOKENS = 1 << 20   # documents are read back in pieces of about so many
PIECES_PER_TASK = 4
MAGIC = b"DACTOK01"
HEAD = struct.Struct("<8sQQQ")      # mark, documents, tokens, levels
LEVEL = struct.Struct("<QQQQQ")     # width, entries, places of codes, bitmap, directory
MANIFEST = "part long, number long, path string, tokens long, pieces array<struct<first:long,documents:long>>"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_SLICE = 1 << 20


def widths(lengths: np.ndarray) -> list[int]:
    """The chunk widths of least total size for values of which ``lengths[b]`` need b bits: a code of a level that is not the last costs a bit more."""
    top = max(int(np.flatnonzero(lengths)[-1]) if lengths.any() else 1, 1)
    beyond = [int(lengths.sum()), *(int(lengths[b + 1:].sum()) for b in range(1, top + 1))]  # values that still have bits from b on
    best: list[tuple[int, list[int]]] = [(0, [])] * (top + 1)
    for b in range(top - 1, -1, -1):
        best[b] = min((beyond[b] * (w + (b + w < top)) + best[b + w][0], [w, *best[b + w][1]]) for w in range(1, top - b + 1))
    return best[0][1]


def pack(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each value, one after another. Eight codes fill ``width`` bytes: up to 16 bits wide they are joined in two words of 64 bits."""
    out = []
    for low in range(0, len(values), _SLICE):
        part = np.ascontiguousarray(values[low:low + _SLICE], dtype="<u4")
        if width > 16:
            out.append(np.packbits(np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width].ravel(), bitorder="little").tobytes())
            continue
        eights = np.zeros((-(-len(part) // 8), 2, 4), "<u8")
        eights.reshape(-1)[:len(part)] = part & np.uint32((1 << width) - 1)
        both = eights[:, :, 0].copy()
        for k in (1, 2, 3):
            both |= eights[:, :, k] << np.uint64(k * width)
        if width < 16:
            second = both[:, 1].copy()
            both[:, 0] |= second << np.uint64(4 * width)
            both[:, 1] = second >> np.uint64(64 - 4 * width)
        out.append(both.view(np.uint8).reshape(-1, 16)[:, :width].tobytes()[:(len(part) * width + 7) // 8])
    return b"".join(out)


def unpack(data: bytes, skip: int, count: int, width: int) -> np.ndarray:
    """``count`` values of ``width`` bits from bit ``skip`` of ``data`` on."""
    if width > 16:
        bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[skip:skip + count * width].reshape(count, width)
        wide = np.zeros((count, 32), np.uint8)
        wide[:, :width] = bits
        return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    rows = -(-count // 8)
    held = np.zeros(rows * width + skip // 8 + width + 4, np.uint8)
    held[:len(data)] = np.frombuffer(data, np.uint8)[:len(held)]
    out = np.empty((rows, 8), "<u4")
    for k in range(8):  # of each eight, code k lies at the same place of its bytes
        at, shift = divmod(skip + k * width, 8)
        three = [held[at + i:at + i + rows * width:width].astype(np.uint32) for i in range(3 if shift + width > 16 else 2)]
        found = three[0] | three[1] << np.uint32(8)
        if len(three) > 2:
            found |= three[2] << np.uint32(16)
        out[:, k] = found >> np.uint32(shift) & np.uint32((1 << width) - 1)
    return out.ravel()[:count]


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """How many ids need b bits, for b from 0 to 32."""
    powers, lengths = np.uint32(1) << np.arange(32, dtype=np.uint32), np.zeros(33, np.int64)
    for low in range(0, len(ids), _SLICE):
        part = ids[low:low + _SLICE]
        times = np.bincount(part) if part.max() < _SLICE else None  # few different ids: they are counted first
        lengths += np.bincount(np.searchsorted(powers, part if times is None else np.arange(len(times), dtype=np.uint32), "right"), times, minlength=33).astype(np.int64)
    return lengths


def encode(doc_ids: pa.Array, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole file: documents begin at ``starts`` (one more entry) of ``ids``."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    plan = widths(bit_lengths(ids))
    documents = [np.asarray(doc_ids.fill_null(0).to_numpy(zero_copy_only=False), "<i8").tobytes(),
                 doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), np.asarray(starts, "<u8").tobytes()]
    at = HEAD.size + LEVEL.size * len(plan) + sum(map(len, documents))
    entries, parts, rest = [], [], ids
    for number, width in enumerate(plan):
        codes, bitmap, ranks = pack(rest, width), b"", b""
        if number + 1 < len(plan):
            more = (rest >> np.uint32(width)) > 0
            bits = np.packbits(more, bitorder="little")
            bitmap = bits.tobytes()
            blocks = np.add.reduceat(np.bitwise_count(bits).astype(np.uint64), np.arange(0, len(bits), BLOCK // 8)) if len(bits) else np.zeros(0, np.uint64)
            ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u8").tobytes()
        entries.append(LEVEL.pack(width, len(rest), at, at + len(codes), at + len(codes) + len(bitmap)))
        parts += [codes, bitmap, ranks]
        at += len(codes) + len(bitmap) + len(ranks)
        if bitmap:
            rest = rest[more] >> np.uint32(width)
    return b"".join([HEAD.pack(MAGIC, len(doc_ids), len(ids), len(plan)), *entries, *documents, *parts])


class TokenFile:
    """Reads ids and documents of a file by range; ``file`` needs ``read_at(length, offset)``."""

    def __init__(self, file):
        self.file = file
        mark, self.documents, self.tokens_, levels = HEAD.unpack(bytes(file.read_at(HEAD.size, 0)))
        if mark != MAGIC:
            raise ValueError("not a file of token ids")
        entries = bytes(file.read_at(LEVEL.size * levels, HEAD.size))
        self.levels = [LEVEL.unpack_from(entries, i * LEVEL.size) for i in range(levels)]
        self.table = HEAD.size + len(entries)

    def _bits(self, at: int, low: int, high: int) -> np.ndarray:
        first = low // 8
        return np.unpackbits(np.frombuffer(bytes(self.file.read_at((high + 7) // 8 - first, at + first)), np.uint8), bitorder="little")[low - 8 * first:high - 8 * first]

    def rank(self, level: int, i: int) -> int:
        """How many of the first i ids of a level go on: a directory entry and at most one block of the bitmap."""
        _, _, _, bitmap, ranks = self.levels[level]
        block = i // BLOCK
        before = int.from_bytes(bytes(self.file.read_at(8, ranks + 8 * block)), "little")
        return before + int(self._bits(bitmap, block * BLOCK, i).sum()) if i % BLOCK else before

    def ids(self, low: int, high: int, level: int = 0) -> np.ndarray:
        """Ids number ``low`` to ``high`` (excluded)."""
        width, _, codes, bitmap, _ = self.levels[level]
        if high <= low:
            return np.zeros(0, np.uint32)
        out = np.empty(high - low, np.uint32)
        for a in range(low, high, _SLICE):
            b = min(high, a + _SLICE)
            first = a * width // 8
            data = bytes(self.file.read_at((b * width + 7) // 8 - first, codes + first))
            out[a - low:b - low] = unpack(data, a * width - 8 * first, b - a, width)
        if level + 1 < len(self.levels):
            more = np.flatnonzero(self._bits(bitmap, low, high))
            begin = self.rank(level, low)
            out[more] |= self.ids(begin, begin + len(more), level + 1) << np.uint32(width)
        return out

    def token(self, i: int) -> int:
        if not 0 <= i < self.tokens_:
            raise IndexError(i)
        return int(self.ids(i, i + 1)[0])

    def document_table(self, low: int, high: int) -> tuple[pa.Array, np.ndarray]:
        """Ids of documents number ``low`` to ``high`` (excluded), and their first tokens (one more entry)."""
        n, at = self.documents, self.table
        ids = np.frombuffer(bytes(self.file.read_at(8 * (high - low), at + 8 * low)), "<i8")
        null = np.frombuffer(bytes(self.file.read_at(high - low, at + 8 * n + low)), np.uint8).astype(bool)
        starts = np.frombuffer(bytes(self.file.read_at(8 * (high - low + 1), at + 9 * n + 8 * low)), "<u8").astype(np.int64)
        return pa.array(ids, pa.int64(), mask=null), starts

    def document(self, number: int) -> np.ndarray:
        """The ids of a document by its place in the file, the end id among them."""
        starts = self.document_table(number, number + 1)[1]
        return self.ids(int(starts[0]), int(starts[1]))


class _Shelf:
    """Gathers documents of a task and writes a file whenever there is enough for one."""

    def __init__(self, folder: str, most: int, piece: int):
        self.folder, self.most, self.piece = folder, most, piece
        self.part, self.number = TaskContext.get().partitionId(), 0
        self.docs, self.sizes, self.ids, self.held = [], [], [], 0

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray):
        """Documents with their sizes and ids; yields a manifest row for each file closed."""
        ends, low = np.cumsum(sizes), 0
        while low < len(sizes):
            before = ends[low - 1] if low else 0
            high = min(len(sizes), int(np.searchsorted(ends, before + self.most - self.held)) + 1)
            self.docs.append(doc_ids[low:high])
            self.sizes.append(sizes[low:high])
            self.ids.append(ids[before:ends[high - 1]])
            self.held += int(ends[high - 1] - before)
            if self.held >= self.most:
                yield self.close()
            low = high

    def close(self) -> pa.RecordBatch:
        sizes = np.concatenate(self.sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data = encode(pa.concat_arrays(self.docs), starts, np.concatenate(self.ids))
        system, base = open_path(self.folder)
        name, own = f"{base}/part-{self.part:06d}-{self.number:06d}.dac", f"{base}/.{self.part}-{uuid.uuid4().hex}"
        with system.open_output_stream(own) as out:
            out.write(data)
        system.move(own, name)
        cuts = np.unique(np.searchsorted(starts, np.arange(0, starts[-1], self.piece), "left").clip(0, len(sizes) - 1))
        pieces = [{"first": int(a), "documents": int(b - a)} for a, b in zip(cuts, np.append(cuts[1:], len(sizes)), strict=True)]
        row = pa.RecordBatch.from_pylist([{"part": self.part, "number": self.number, "path": f"{self.folder}/part-{self.part:06d}-{self.number:06d}.dac",
                                           "tokens": int(starts[-1]), "pieces": pieces}],
                                         pa.schema([("part", pa.int64()), ("number", pa.int64()), ("path", pa.string()), ("tokens", pa.int64()),
                                                    ("pieces", pa.list_(pa.struct([("first", pa.int64()), ("documents", pa.int64())])))]))
        self.number, self.docs, self.sizes, self.ids, self.held = self.number + 1, [], [], [], 0
        return row


def _write(folder: str, vocabulary, end: int, most: int, piece: int):
    def run(batches):
        model, shelf = tokens.byte_tokenizer(vocabulary.value, False), _Shelf(folder, most, piece)
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column("text"), 1 << 22):
                with tokens.uncollected():
                    ids, starts = tokens.encode_rows(model.memo, data, offsets, model.signs)
                ids = np.insert(ids, starts[1:], end)
                yield from shelf.add(batch.column("doc_id")[low:high], np.diff(starts) + 1, ids)
        if shelf.held:
            yield shelf.close()
    return run


def write_tokens(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", vocabulary: str = tokens.BYTES, end: int = END,
                 file_tokens: int = FILE_TOKENS, piece_tokens: int = PIECE_TOKENS) -> DataFrame:
    """Encode every whole text (null: empty), append the id ``end``, and write files in ascending order of id; returns the manifest, a row for each file.

    Strings of special tokens in texts become those tokens, as the tokenizer does by itself. Null ids come first; rows of one id are ordered by a hash of their text, then by the text, so equal
    rows are the only ties. Rows are dealt by id and that hash, so rows of one id need not meet in one task. An empty table writes no files; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    system, base = open_path(folder)
    system.create_dir(base)
    with open(vocabulary, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(*order)
    with with_small_batches(spark):
        return materialise(rows.mapInArrow(_write(folder, content, end, file_tokens, piece_tokens), MANIFEST))


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            system, name = open_path(row["path"])
            with system.open_input_file(name) as raw:
                file = TokenFile(raw)
                ids, starts = file.document_table(row["first"], row["first"] + row["documents"])
                sums = [0] * len(ids)
                for a in range(int(starts[0]), int(starts[-1]), 4 * _SLICE):  # a document longer than that is summed piece by piece
                    b = min(int(starts[-1]), a + 4 * _SLICE)
                    found = file.ids(a, b).astype("<u4")
                    for i in range(int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))):
                        sums[i] = zlib.crc32(found[max(int(starts[i]) - a, 0):int(starts[i + 1]) - a], sums[i])
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts[:-1] + row["start"]), pa.array(np.diff(starts)), pa.array(sums, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document of the files of ``manifest``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The files' starts come from running sums over the manifest, which has a row for each file; pieces of files are dealt over the tasks and read by range.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = materialise(manifest.withColumn("start", before).select("path", "start", F.inline("pieces")))
    tasks = max(1, -(-pieces.count() // PIECES_PER_TASK))
    return pieces.repartition(tasks, "path", "first").mapInArrow(_read, DOCUMENTS)


def tokens_of(manifest: DataFrame, positions: DataFrame) -> DataFrame:
    """position, id of the tokens at the global ``positions`` (first column), each read from the file that holds it; positions outside give no rows.

    Positions and files meet in bins of ``FILE_TOKENS`` positions.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("start"), (before + F.col("tokens")).alias("end"))
    bins = F.sequence(F.floor(F.col("start") / FILE_TOKENS), F.floor((F.col("end") - 1) / FILE_TOKENS))
    files = materialise(files.withColumn("bin", F.explode(bins)))
    wanted = positions.select(F.col(positions.columns[0]).cast("long").alias("position")).withColumn("bin", F.floor(F.col("position") / FILE_TOKENS))
    held = wanted.join(files, "bin").filter("position >= start and position < end")
    return held.select("position", "path", (F.col("position") - F.col("start")).alias("at")).mapInArrow(_look, "position long, id long")


def _look(batches):
    for batch in batches:
        rows, out = batch.to_pylist(), []
        for path in dict.fromkeys(r["path"] for r in rows):
            system, name = open_path(path)
            with system.open_input_file(name) as raw:
                file = TokenFile(raw)
                out += [(r["position"], file.token(r["at"])) for r in rows if r["path"] == path]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["position", "id"])
