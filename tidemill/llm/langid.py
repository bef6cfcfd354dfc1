"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with frozen counts. A byte seen in the longest known context has the
probability n / (N + d) there (N bytes seen, d different ones); else the escape d / (N + d) is paid and the context loses its oldest
byte, down to 256 equal bytes. The exact code length of a whole text is the sum over its bytes; the language with the shortest code wins.

The trees come from a bounded sample of labelled documents, whole texts. For scoring they are laid out as sorted tables: for every context and byte
seen in any language the code lengths in all languages, and for every context the escape lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import chunks, fold

ORDER = 3
SAMPLE_ROWS = 400      # labelled documents a language learns from
START = 1              # the byte that stands before a text
TRAIN_SCHEMA = "lang string, gram long, n long"


def _lower(column):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte of the rows the number of the ``order`` bytes before it, and it itself; rows begin with ``START`` bytes."""
    codes = data.astype(np.int64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = codes.copy()
    for k in range(1, order + 1):
        before = np.full(len(data), START, dtype=np.int64)
        before[k:] = codes[:-k] if k < len(data) else before[k:]
        out += np.where(place >= k, before, START) << 8 * k
    return out


def _counted(batches):
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            rows = batch.column("text").filter(pa.array([x == lang for x in langs]))
            for _, _, data, offsets in chunks(_lower(rows)):
                found, n = np.unique(grams(data, offsets, ORDER), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], names=["lang", "gram", "n"])


@dataclass
class Model:
    """Per order, sorted grams with the code lengths of their last byte, and sorted contexts with their escape lengths; a column a language."""

    langs: list[str]
    grams: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def lengths(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Code lengths in bits: a row for each gram of ``order``, a column for each language."""
        if order < 0:
            return np.full((len(codes), len(self.langs)), 8.0, np.float32)
        known = self.grams[order]
        if not len(known):
            return self.lengths(codes & ((1 << 8 * max(order, 0)) - 1), order - 1)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        out = self.costs[order][at]
        miss = np.flatnonzero(known[at] != codes)
        if len(miss):
            out[miss] = self.escape(codes[miss] >> 8, order) + self.lengths(codes[miss] & ((1 << 8 * order) - 1), order - 1)
        return out

    def escape(self, contexts: np.ndarray, order: int) -> np.ndarray:
        known = self.contexts[order]
        at = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
        return np.where((known[at] == contexts)[:, None], self.escapes[order][at], 0)


def build(langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model from each language's grams of the highest order and their counts; lower orders are their sums."""
    model = Model(langs, [], [], [], [])
    for order in range(ORDER + 1):
        mask = (1 << 8 * (order + 1)) - 1
        every = np.unique(np.concatenate([g & mask for g, _ in counts])) if counts else np.zeros(0, np.int64)
        contexts, owner = np.unique(every >> 8, return_inverse=True)
        n = np.zeros((len(every), len(langs)))
        for j, (g, c) in enumerate(counts):
            np.add.at(n[:, j], np.searchsorted(every, g & mask), c)
        total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(total, owner, n)
        np.add.at(kinds, owner, n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escapes = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            own = -np.log2(n / (total + kinds)[owner])
        lower = model.lengths(every & ((1 << 8 * order) - 1), order - 1)
        model.grams.append(every)
        model.costs.append(np.where(n > 0, own, escapes[owner] + lower).astype(np.float32))
        model.contexts.append(contexts)
        model.escapes.append(escapes.astype(np.float32))
    return model


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """The model from about ``rows`` documents a language at most, chosen by the hash of their id; null languages teach nothing."""
    labelled = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    labelled = labelled.filter("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))  # a row for each language
    share = F.floor(F.lit(2 ** 31) * rows / F.col("_n"))
    chosen = labelled.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(2 ** 31)) < share)
    found = chosen.select("lang", "text").mapInArrow(_counted, TRAIN_SCHEMA)
    table = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "gram").toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    names = np.array(table.column("lang").to_pylist(), dtype=object)
    gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    return build(langs, [(gram[names == x], n[names == x]) for x in langs])


def _scored(model):
    def run(batches):
        found = model.value
        for batch in batches:
            lower = _lower(batch.column("text"))
            letters = pc.match_substring_regex(lower, r"\p{L}").to_numpy(zero_copy_only=False)
            bits = np.zeros((batch.num_rows, len(found.langs)))
            size = np.diff(np.frombuffer(lower.buffers()[1], np.int64)[lower.offset:lower.offset + len(lower) + 1]) if len(lower) else np.zeros(0, np.int64)
            for low, high, data, offsets in chunks(lower):
                full = np.flatnonzero(np.diff(offsets))
                if len(full) and found.langs:
                    bits[low + full] = np.add.reduceat(found.lengths(grams(data, offsets, ORDER)), offsets[:-1][full], axis=0, dtype=np.float64)
            known = letters & bool(found.langs)
            best = bits.argmin(1) if found.langs else np.zeros(batch.num_rows, np.int64)
            # Neighbouring bytes are no independent evidence: it counts by the root of the length.
            share = np.exp2(-(bits - bits.min(1, keepdims=True)) / np.sqrt(np.maximum(size, 1))[:, None]) if found.langs else np.ones((batch.num_rows, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([found.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], pa.string()),
                 pa.array(np.where(known, 1 / share.sum(1), 0.0)), pa.array(np.where(known, bits.min(1) if found.langs else 0.0, 0.0))],
                names=["doc_id", "lang_pred", "score", "code_bits"])
    return run


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), code_bits of every row. A null text, or one without a letter, is ``und`` with score 0, as is any text
    if nothing was learned. Ties go to the first language by name. Repeated rows and null ids are scored each; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(_scored(shared), "doc_id long, lang_pred string, score double, code_bits double")


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from documents whose crc32(id) modulo 4 is not 2, then predict all: doc_id, held_out, lang_pred, score, code_bits."""
    model = train(docs.filter(fold(F.col(doc_id), 4) != 2), doc_id, text, lang, rows)
    found = identify(docs, model, doc_id, text)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "code_bits")
