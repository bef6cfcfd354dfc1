"""Benchmark decontamination: edit-distance search of items in documents by the CGK embedding and bit-sampling.

Texts are sequences of words (runs of letters and digits, lower case). The CGK random walk copies the word under its
head at each step and moves on by a random bit of (repetition, step, word); two sequences at small edit distance
come back into step, so their walks have a small Hamming distance. A repetition starts its walk at some offset of each item-sized
window and samples ``SAMPLED`` of the walk's first ``STEPS`` outputs; windows that agree on all samples with an item are
candidates. Items under ``SHORT`` words have too few starts for that: they are cut into one piece more than the edits allowed, so that one piece stands
unchanged in every copy, and windows that hold a piece are candidates. A piece is a walk that moves at each step. Each candidate is verified by the exact edit distance of the item to the best stretch of the window.

The walk of a document's windows is followed lazily: a start whose first samples fit no item is dropped there, which finds
the same candidates as whole keys would. Items are the query set: blocks of ``BLOCK`` items and ``BLOCK_WORDS`` words go to the tasks as one broadcast each, whose size these bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import chunks, hash_spans, mix, spans_of

REPETITIONS = 24
STEPS = 8
SAMPLED = 4
SHORT = 15
BLOCK, BLOCK_WORDS = 1000, 200_000   # items of a block, and their words in all; a longer item is a block of its own
EDITS = 0.2
TRIES, OFTEN = 6, 4   # random offsets to choose a start from, and how often one offset is preferred

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SCHEMA = "doc_id long, item_id long, distance long, item_words long, start_word long, end_word long"


def _lower(column):
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins, ends = spans_of(_LETTER[data], offsets)
    return hash_spans(data, begins, ends), np.searchsorted(begins, offsets)


@dataclass
class Index:
    """Word numbers (1 …; 0 is any other word), the items as numbers, and for each repetition the sampled prefixes of the items' walks."""

    vocabulary: np.ndarray
    item_ids: np.ndarray
    items: list[np.ndarray]
    member: np.ndarray           # sorted item * words + word of the words of each item
    moves: np.ndarray            # per repetition and word, one bit for each step
    samples: list[list[int]]     # per repetition, the sampled steps; the first is 0
    starts: np.ndarray           # per word, 64 repetitions to a number, one bit for each in which an item's walk begins with it
    prefixes: list[list[np.ndarray]]   # per repetition and sample, the sorted keys of the items so far
    owners: list[tuple[np.ndarray, np.ndarray, np.ndarray]]   # per repetition: sorted full keys, item, offset


def _key(key, word):
    with np.errstate(over="ignore"):
        return mix(key * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64) + np.uint64(1))


def _cuts(words: int, edits: float) -> list[int]:
    """The ends of an item's pieces, one more than the edits allowed."""
    pieces = min(int(edits * words) + 1, words)
    return [words * k // pieces for k in range(pieces + 1)]


def build_index(item_ids: list[int], texts: list[str], repetitions: int = REPETITIONS, seed: int = 11, edits: float = EDITS) -> Index:
    hashes = []
    for _, _, data, offsets in chunks(_lower(pa.array(texts, pa.string()))):
        found, first = _word_hashes(data, offsets)
        hashes += [found[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    items = [np.searchsorted(vocabulary, h).astype(np.int64) + 1 for h in hashes]
    spread = np.bincount(np.concatenate([np.unique(i) for i in items]) if items else [], minlength=len(vocabulary) + 1)
    random = np.random.default_rng(seed)
    words = len(vocabulary) + 1
    cuts = [_cuts(len(item), edits) if 0 < len(item) < SHORT else [] for item in items]
    pieces = max((len(c) - 1 for c in cuts if c), default=0)
    moves = np.concatenate([random.integers(0, 256, (repetitions, words), dtype=np.uint8), np.full((pieces, words), 255, np.uint8)])
    samples, prefixes, owners = [], [], []
    used = [np.zeros(len(item), dtype=np.int64) for item in items]
    starts = np.zeros((words, (repetitions + pieces + 63) // 64), dtype=np.uint64)
    for r in range(repetitions + pieces):
        steps = list(range(STEPS)) if r >= repetitions else [0, *sorted(random.choice(np.arange(1, STEPS), SAMPLED - 1, replace=False).tolist())]
        samples.append(steps)
        levels: list[list[int]] = [[] for _ in steps]
        full: list[tuple[int, int, int]] = []
        for number, item in enumerate(items):
            if not len(item) or (len(item) < SHORT) != (r >= repetitions) or (r >= repetitions and r - repetitions >= len(cuts[number]) - 1):
                continue
            if r >= repetitions:
                offset, end = cuts[number][r - repetitions:r - repetitions + 2]
                key = np.zeros(1, np.uint64)
                for step, word in enumerate(item[offset:min(end, offset + STEPS)]):
                    key = _key(key, word[None])
                    levels[step].append(int(key[0]))
                starts[item[offset], r // 64] |= np.uint64(1) << np.uint64(r % 64)
                full.append((int(key[0]), number, offset))
                continue
            # Of some random offsets the one whose word the fewest items have, but none too often: fewer starts to follow, the same windows.
            tries = random.integers(0, max(1, len(item) - STEPS + 1), TRIES)
            offset = int(min(tries, key=lambda o: (used[number][o] >= OFTEN, spread[item[o]])))
            used[number][offset] += 1
            key, at, level = np.zeros(1, np.uint64), offset, 0
            for step in range(STEPS):
                if at >= len(item):
                    break  # the walk left a short item; its key ends here
                if step in steps:
                    key = _key(key, item[at:at + 1])
                    levels[level].append(int(key[0]))
                    level += 1
                at += int(moves[r, item[at]] >> step & 1)
            starts[item[offset], r // 64] |= np.uint64(1) << np.uint64(r % 64)
            full.append((int(key[0]), number, offset))
        prefixes.append([np.unique(np.array(x, dtype=np.uint64)) for x in levels])
        full.sort()
        owners.append((np.array([x[0] for x in full], np.uint64), np.array([x[1] for x in full], np.int64), np.array([x[2] for x in full], np.int64)))
    member = [number * words + np.unique(item) for number, item in enumerate(items)]
    member = np.concatenate(member) if member else np.zeros(0, np.int64)
    return Index(vocabulary, np.array(item_ids, np.int64), items, member, moves, samples, starts, prefixes, owners)


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def candidates(index: Index, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct rows (document, item, window start) whose walks agree with an item's on all samples of a repetition.

    ``words`` are the numbers of a run of documents, ``first`` the place of each document's first word, and the end.
    """
    ends = np.repeat(first[1:], np.diff(first))
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    longest = max(map(len, index.items), default=0)
    span = len(words) + longest + 1
    masks = index.starts[words]
    begun = np.flatnonzero(masks.any(axis=1))
    masks = masks[begun]
    found = []
    for r, steps in enumerate(index.samples):
        p = begun[(masks[:, r // 64] >> np.uint64(r % 64) & np.uint64(1)).astype(bool)]
        if not len(p):
            continue
        at, last, key, level = p.copy(), ends[p], np.zeros(len(p), np.uint64), 0
        keys, items, offsets = index.owners[r]
        for step in range(STEPS):
            if step in steps:
                key = _key(key, words[at])
                on = _member(key, index.prefixes[r][level])
                level += 1
                p, at, last, key = p[on], at[on], last[on], key[on]
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                for k in range(int((high - low).max(initial=0))):
                    some = low + k < high
                    owner = low[some] + k
                    found.append((rows[p[some]] * len(index.items) + items[owner]) * span + p[some] - offsets[owner] + longest)
                if not len(p):
                    break
            at = at + (index.moves[r, words[at]] >> np.uint8(step) & 1)
            on = at < last
            p, at, last, key = p[on], at[on], last[on], key[on]
    code = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    pair, start = code // span, code % span - longest
    return np.stack([pair // max(len(index.items), 1), pair % max(len(index.items), 1), start], 1)


def best_stretch(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """The least edit distance of ``item`` to any stretch of ``window``, and the end of the first such stretch."""
    places = np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, dtype=np.int64)
    for word in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (window != word))
        row = np.minimum.accumulate(new - places) + places
    return int(row.min()), int(row.argmin())


def _likely(index: Index, words: np.ndarray, first: np.ndarray, found: np.ndarray, edits: float) -> np.ndarray:
    """The candidates whose window holds enough words of the item: each word that is not edited away stands in it."""
    sizes = np.array([len(i) for i in index.items])
    out = []
    for low in range(0, len(found), 1 << 14):
        some = found[low:low + (1 << 14)]
        size = sizes[some[:, 1]]
        allowed = (edits * size).astype(np.int64)
        begin = np.maximum(some[:, 2] - allowed, first[some[:, 0]])
        end = np.minimum(some[:, 2] + size + allowed, first[some[:, 0] + 1])
        at = begin[:, None] + np.arange(int((end - begin).max(initial=0)))
        near = some[:, 1][:, None] * (len(index.vocabulary) + 1) + words[np.minimum(at, len(words) - 1)]
        inside = _member(near.ravel(), index.member).reshape(near.shape) & (at < end[:, None])
        out.append(some[inside.sum(1) >= size - allowed])
    return np.concatenate(out) if out else found


def _matches(index: Index, words: np.ndarray, first: np.ndarray, edits: float) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, distance, item words, start, end) of the best match of each item in each document."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for row, number, start in _likely(index, words, first, candidates(index, words, first), edits).tolist():
        item = index.items[number]
        allowed = int(edits * len(item))
        low, high = max(start - allowed, first[row]), min(start + len(item) + allowed, first[row + 1])
        known = best.get((row, number))
        if known and (known[0] == 0 or low <= known[1] <= start + allowed):
            continue
        window = words[low:high]
        at = start - low
        if 0 <= at and np.array_equal(window[at:at + len(item)], item):
            distance, begin, end = 0, start, start + len(item)
        else:
            distance, end = best_stretch(item, window)
            if distance > allowed:
                continue
            end, begin = low + end, low + end - _tail(item, window[:end])
        if not known or (distance, begin) < known[:2]:
            best[row, number] = (distance, int(begin), int(end))
    return [(row, number, d, len(index.items[number]), b - int(first[row]), e - int(first[row])) for (row, number), (d, b, e) in sorted(best.items())]


def _tail(item: np.ndarray, window: np.ndarray) -> int:
    """Length of the shortest best-matching stretch that ends where ``window`` ends."""
    back = np.arange(len(window) + 1)
    row = back.copy()
    for i, word in enumerate(item[::-1], 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (window[::-1] != word))
        new[0] = i
        row = np.minimum.accumulate(new - back) + back
    return int(row.argmin())


def _found(index: Index, column, edits: float) -> list[tuple[int, int, int, int, int, int]]:
    rows = []
    for low, _, data, offsets in chunks(_lower(column)):
        hashes, first = _word_hashes(data, offsets)
        if len(hashes) and len(index.vocabulary):
            at = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.vocabulary) - 1)
            words = np.where(index.vocabulary[at] == hashes, at + 1, 0)
            rows += [(low + r, *rest) for r, *rest in _matches(index, words, first, edits)]
    return rows


def _search(index, edits: float):
    def run(batches):
        for batch in batches:
            rows = _found(index.value, batch.column(1), edits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([int(index.value.item_ids[r[1]]) for r in rows], pa.int64()),
                 *(pa.array([r[k] for r in rows], pa.int64()) for k in range(2, 6))],
                names=["doc_id", "item_id", "distance", "item_words", "start_word", "end_word"])
    return run


def indexes(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", repetitions: int = REPETITIONS,
            edits: float = EDITS):
    """One broadcast index for each block of items, in order of their ids; items without an id are left out."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).filter("id is not null").orderBy("id", "text")
    def index(block):
        return spark.sparkContext.broadcast(build_index([r[0] for r in block], [r[1] or "" for r in block], repetitions, edits=edits))

    block, held = [], 0
    for row in items.withColumn("words", F.octet_length(F.coalesce("text", F.lit(""))) / 2).toLocalIterator():  # a word and what parts it have two bytes at least
        if block and (len(block) == BLOCK or held + row["words"] > BLOCK_WORDS):
            yield index(block)
            block, held = [], 0
        block.append(row)
        held += row["words"]
    if block:
        yield index(block)


def find_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", edits: float = EDITS, repetitions: int = REPETITIONS) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, distance, item_words, start_word, end_word.

    One row per document and item: the stretch of least word edit distance among the verified ones, the first of equal ones; at most
    ``edits`` times the item's words, rounded down, so items under five words match only unchanged. Items and texts without words
    (null, empty) match nothing; rows that repeat an id are searched each. Empty tables give no rows; other columns are not read.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for index in indexes(benchmark, item_id, item_text, repetitions, edits):
        found = found.unionByName(source.mapInArrow(_search(index, edits), SCHEMA))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", edits: float = EDITS,
               repetitions: int = REPETITIONS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, all columns, in one pass without a join."""
    def run(index):
        def clean(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[r[0] for r in _found(index.value, batch.column(text), edits)]] = False
                yield batch.filter(pa.array(keep))
        return clean
    for index in indexes(benchmark, item_id, item_text, repetitions, edits):
        docs = docs.mapInArrow(run(index), docs.schema)
    return docs
