"""Language-model scores by a subword lattice.

The vocabulary of a public tokenizer is taken as it is. Its pieces start with unigram probabilities from the vocabulary's own scores (ranks, as a Zipf law); ``ROUNDS`` rounds of expectation and
maximisation over the lattice then fit them to the training words: every segmentation of a word counts as much as it is likely, by forward and backward recursion, with the scores of
the start as ``PRIOR`` pseudo-counts. The probability of a text is the sum over all
segmentations of its words into pieces (single bytes included, so every word has one), times that of the end. No piece crosses a
word, so the forward recursion in log space runs once for each different word of the corpus, and a text is a sum over its words.

Words are counted by a shuffle over the whole corpus. The ``FREQUENT`` most counted words, a table of fixed size, go to every task, which settles them
in place; the other words of each document meet their counts in a join.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import Spans, chunks, fold, hash_spans, lower_bytes, text_bytes, words
from tidemill.session import materialise

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT = 1 << 16
PRIOR = 1000.0     # pseudo-count of the vocabulary's own scores
ROUNDS = 3         # of expectation and maximisation
CELLS = 1 << 20    # places of words that go through both recursions at once
ADD = 0.1          # added to each token's count in the base score
HEAD = "▁"    # the mark before a word


def _gather(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as an Arrow string column."""
    size = ends - begins
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at].tobytes())).cast(pa.string())


def _counts(batches):
    """word, n (all occurrences), c (in training rows) of each run of texts."""
    for batch in batches:
        learn = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        for low, high, data, offsets in chunks(batch.column("text"), 1 << 22):
            hashes, begins, ends, first = words(data, offsets)
            _, at, group = np.unique(hashes, return_index=True, return_inverse=True)
            taught = np.repeat(learn[low:high], np.diff(first))
            yield pa.RecordBatch.from_arrays(
                [_gather(lower_bytes(data), begins[at], ends[at]), pa.array(np.bincount(group[taught], minlength=len(at)))], names=["word", "c"])


@lru_cache(2)
def _processor(proto: bytes):
    found = sentencepiece.SentencePieceProcessor()
    found.LoadFromSerializedProto(proto)
    return found


def _expected(lattice):
    """How often each piece is used in the training words, over all their segmentations."""
    def run(batches):
        total = 0.0
        for batch in batches:
            total = total + lattice.value.expected(batch.column("word"), batch.column("c").to_numpy().astype(np.float64))
        used = np.flatnonzero(total) if isinstance(total, np.ndarray) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(np.asarray(total)[used] if len(used) else np.zeros(0))], names=["id", "n"])
    return run


class Lattice:
    """Natural-log probabilities of the pieces by the hash of their bytes, and the forward recursion over words."""

    def __init__(self, proto: bytes, counts: dict[int, float], documents: int, prior: float = PRIOR):
        model = _processor(proto)
        size = model.vocab_size()
        rank = np.array([-model.get_score(i) for i in range(size)])
        usable = np.array([not (model.is_control(i) or model.is_unknown(i)) for i in range(size)])
        inner = np.array([HEAD in model.id_to_piece(i)[1:] for i in range(size)])
        usable &= ~inner
        zipf = np.where(usable, 1 / (2.7 + np.where(rank < 1e8, rank, 0)), 0)
        seen = np.array([counts.get(i, 0) for i in range(size)], dtype=np.float64) * usable
        ends = documents + 1.0
        weight = seen + prior * zipf / zipf.sum()
        total = weight.sum() + ends
        self.end = math.log(ends / total)
        single = np.full(256, -np.inf)
        texts, logs, ids = [], [], []
        self.size, self.byte_ids = size, np.full(256, -1, np.int64)   # the piece to which uses of a single byte are put down
        for i in np.flatnonzero(usable):
            piece, log = model.id_to_piece(int(i)), math.log(weight[i] / total)
            if model.is_byte(int(i)):
                b = int(piece[3:5], 16)
                single[b] = np.logaddexp(single[b], log)
                self.byte_ids[b] = i
            elif len(raw := piece.encode()) == 1:
                single[raw[0]] = np.logaddexp(single[raw[0]], log)
                self.byte_ids[raw[0]] = i
            else:
                texts.append(raw)
                logs.append(log)
                ids.append(i)
        self.single = single
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends_ = np.cumsum([len(t) for t in texts])
        begins = ends_ - np.array([len(t) for t in texts])
        hashes = hash_spans(data, begins, ends_)
        order = np.argsort(hashes)
        self.hashes, self.logs, self.ids = hashes[order], np.array(logs)[order], np.array(ids, np.int64)[order]
        self.sizes = sorted({len(t) for t in texts})

    def _sorted(self, column):
        """The bytes of all words with the mark before them, the order of words by falling size, and their begins and sizes in it."""
        column = pc.binary_join_element_wise(pa.scalar(HEAD, pa.large_string()), column.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        data, offsets = text_bytes(column)
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        return data, order, offsets[:-1][order], size[order]

    def _found(self, spans: Spans, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places ``at`` end a piece of k bytes, and the piece."""
        hashes = spans.hashes(at - k, at)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[place] == hashes)
        return hit, place[hit]

    def words(self, column) -> np.ndarray:
        """The natural-log probability of each word of an Arrow column, summed over all segmentations."""
        data, order, begin, size = self._sorted(column)
        out = np.zeros(len(order))
        if not len(order):
            return out
        spans = Spans(data)
        widest = self.sizes[-1] if self.sizes else 1
        ring = np.full((widest + 1, len(order)), -np.inf)
        ring[0] = 0.0
        active = np.searchsorted(-size, -np.arange(size[0] + 1), "right")
        for j in range(1, int(size[0]) + 1):
            m = int(active[j])
            at = begin[:m] + j
            now = ring[(j - 1) % (widest + 1), :m] + self.single[data[at - 1]]
            for k in self.sizes:
                if k > j:
                    break
                hit, place = self._found(spans, at, k)
                if len(hit):
                    now[hit] = np.logaddexp(now[hit], ring[(j - k) % (widest + 1), hit] + self.logs[place])
            ring[j % (widest + 1), :m] = now
            done = size[:m] == j
            out[:m][done] = now[done]
        back = np.empty(len(order))
        back[order] = out
        return back

    def expected(self, column, times: np.ndarray) -> np.ndarray:
        """Per piece of the vocabulary, how often it is used in the words of an Arrow column that occur ``times`` often, over all segmentations by their likelihood."""
        data, order, begin, size = self._sorted(column)
        times, total, spans, low = times[order], np.zeros(self.size), Spans(data), 0
        while low < len(order):
            high = low + max(1, min(len(order) - low, CELLS // (int(size[low]) + 1)))
            self._both_ways(data, spans, begin[low:high], size[low:high], times[low:high], total)
            low = high
        return total

    def _both_ways(self, data, spans, begin, size, times, total) -> None:
        longest, every = int(size[0]), np.arange(len(size))
        active = np.searchsorted(-size, -np.arange(longest + 1), "right")
        ahead = np.full((longest + 1, len(size)), -np.inf)
        ahead[0] = 0.0
        pieces: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(longest + 1)]
        for j in range(1, longest + 1):
            m = int(active[j])
            at = begin[:m] + j
            now = ahead[j - 1, :m] + self.single[data[at - 1]]
            for k in self.sizes:
                if k > j:
                    break
                hit, place = self._found(spans, at, k)
                if len(hit):
                    now[hit] = np.logaddexp(now[hit], ahead[j - k, hit] + self.logs[place])
                    pieces[j].append((k, hit, place))
            ahead[j, :m] = now
        whole = ahead[size, every]
        back = np.full((longest + 1, len(size)), -np.inf)
        back[size, every] = 0.0
        for j in range(longest, 0, -1):
            for k, hit, place in pieces[j]:
                rest = back[j, hit] + self.logs[place]
                np.add.at(total, self.ids[place], np.exp(ahead[j - k, hit] + rest - whole[hit]) * times[hit])
                back[j - k, hit] = np.logaddexp(back[j - k, hit], rest)
            m = int(active[j])
            byte = data[begin[:m] + j - 1]
            rest = back[j, :m] + self.single[byte]
            np.add.at(total, self.byte_ids[byte], np.exp(ahead[j - 1, :m] + rest - whole[:m]) * times[:m])
            back[j - 1, :m] = np.logaddexp(back[j - 1, :m], rest)


def _logged(lattice):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(lattice.value.words(batch.column("word")))],
                                             names=["word", "c", "log_p"])
    return run


def _settled(frequent, base_end: float, end: float):
    """Per document one row with what frequent words and the end give, and a row for each other word."""
    def run(batches):
        hashes, base, logs, known = frequent.value
        row = 0
        part = TaskContext.get().partitionId() << 40
        for batch in batches:
            held, ids = batch.column("held_out"), batch.column("doc_id")
            for low, high, data, offsets in chunks(batch.column("text")):
                h, begins, ends, first = words(data, offsets)
                n = np.diff(first)
                doc = np.repeat(np.arange(len(n)), n)
                place = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0)) if len(hashes) else np.zeros(len(h), np.int64)
                hit = hashes[place] == h if len(hashes) else np.zeros(len(h), dtype=bool)
                sums = [np.bincount(doc[hit], weights=x[place[hit]], minlength=len(n)) for x in (base, logs, known)]
                rest = np.flatnonzero(~hit)
                order = rest[np.lexsort((h[rest], doc[rest]))]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                start = np.flatnonzero(new)
                times = np.diff(np.append(start, len(order)))
                head = order[start]
                key = part + row + np.arange(len(n))
                carriers = pa.array([f" {k & 4095}" for k in key.tolist()], pa.string())
                rare = _gather(lower_bytes(data), begins[head], ends[head])
                carried = pa.StructArray.from_arrays(
                    [pa.concat_arrays([x.cast(kind), pa.nulls(len(head), kind)]) for x, kind in (
                        (ids[low:high], pa.int64()), (held[low:high], pa.bool_()), (pa.array(n + 1), pa.int64()), (pa.array(sums[0] + base_end), pa.float64()),
                        (pa.array(sums[1] + end), pa.float64()), (pa.array(np.rint(sums[2])), pa.int64()))],
                    names=["doc_id", "held_out", "n_tokens", "base", "log_p", "known"], mask=pa.array(np.arange(len(n) + len(head)) >= len(n)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([key, key[doc[head]]])), pa.concat_arrays([carriers, rare]),
                     pa.array(np.concatenate([np.zeros(len(n), np.int64), times])), carried], names=["key", "word", "n", "own"])
                row += len(n)
    return run


SETTLED = ("key long, word string, n long, own struct<doc_id:long,held_out:boolean,n_tokens:long,base:double,log_p:double,known:long>")


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, frequent: int = FREQUENT,
              rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from rows whose crc32(id) modulo 10 is not 0. Tokens are the words, A-Z lowered, and one end. The base score adds ``ADD`` to every count;
    ``score`` is the lattice probability of the words and the end. A null or empty text is the end alone. Without training
    rows the counts are zero and the vocabulary's own scores decide. Repeated rows and null ids are rows of their own; an empty table gives an
    empty table; other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                         (fold(F.col(doc_id), 10) == 0).alias("held_out"))
    counts = source.mapInArrow(_counts, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = materialise(counts)
    taught = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("c") > 0, 1)), F.lit(0))).first()
    documents = source.filter("not held_out").count()
    tokens, kinds = taught[0] + documents, taught[1] + (1 if documents else 0)
    with open(vocabulary, "rb") as file:
        proto = spark.sparkContext.broadcast(file.read())
    lattice = Lattice(proto.value, {}, documents)
    for _ in range(rounds if tokens else 0):
        used = counts.filter("c > 0").mapInArrow(_expected(spark.sparkContext.broadcast(lattice)), "id long, n double").groupBy("id").agg(F.sum("n").alias("n"))
        lattice = Lattice(proto.value, {r["id"]: r["n"] for r in used.collect()}, documents)
    logged = materialise(counts.mapInArrow(_logged(spark.sparkContext.broadcast(lattice)), "word string, c long, log_p double"))
    below = tokens + ADD * (kinds + 1)

    def base(c):
        return F.log10((c + F.lit(ADD)) / F.lit(below))

    # The counts from which on words are frequent: eighths of powers of two, as many as stay within the bound.
    step = F.floor(F.log2(F.col("c")) * 8).cast("int")
    steps, least, sum_ = counts.filter("c > 0").groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect(), None, 0
    for r in steps:
        sum_ += r["count"]
        if sum_ > frequent:
            break
        least = r["s"]
    top = logged.filter((F.col("c") > 0) & (step >= F.lit(least)) if least is not None else F.lit(False)).toArrow()
    hashes = words(*text_bytes(top.column("word")))[0] if len(top) else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    c = top.column("c").to_numpy().astype(np.float64)[order]
    table = (hashes[order], np.log10((c + ADD) / below), top.column("log_p").to_numpy()[order], (c > 0).astype(np.float64))
    settled = source.mapInArrow(_settled(spark.sparkContext.broadcast(table), math.log10((documents + ADD) / below), lattice.end), SETTLED)
    met = settled.join(logged.select("word", "c", F.col("log_p").alias("word_log")), "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = F.col("n") > 0
    rows = met.groupBy("key").agg(
        F.max("own.doc_id").alias("doc_id"), F.max("own.held_out").alias("held_out"), F.max("own.n_tokens").alias("n_tokens"),
        (F.max("own.known") + F.sum(F.when(c > 0, F.col("n")).otherwise(0)) + F.lit(1 if documents else 0)).alias("n_known"),
        (F.max("own.base") + F.sum(F.when(rare, F.col("n") * base(c)).otherwise(0.0))).alias("base_score"),
        ((F.max("own.log_p") + F.sum(F.when(rare, F.col("n") * F.col("word_log")).otherwise(0.0))) / math.log(10)).alias("score"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
