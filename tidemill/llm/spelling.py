"""Spelling variants of a corpus's words by a bit-sliced position index.

Two words are near when one inserted, deleted or replaced code point turns one into the other. Words meet in blocks: of two near words, of length L and L or L + 1,
either the first L // 2 code points are the same or the last L - L // 2, as the one error lies in one part. In a block, bit k of every set stands for word k, and
for each position and letter a set holds the words with that letter there. A word is looked up by reading its letters: E holds the words equal so far, R those with one replaced letter,
I those with one letter more and D those with one less; the sets are cut with those of the same position, the next and the one before. One step of the recurrence moves all
words of the block by machine words, and all look-ups of a run of blocks at once. A pair that also agrees in the first part is left to that block (its bits of E there are
taken out), so each is found in one block alone. Bits are in order of falling counts, so the lowest bit found is the near word of largest count.

A block of more than ``BLOCK`` words is dealt into slices, and look-ups of a slice meet the index of each slice in a task of its own: all words are looked up in all words of
the block, none is dropped, and no task sees the whole block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import LOWER, UPPER
from tidemill.session import materialise

LETTERS = "[A-Za-zÀ-ÿ]"
SHORTEST, LEAST, TIMES, CUT = 6, 5, 5, 199
BLOCK = 8192
PLANE_BYTES = 32 << 20   # letter sets of a run of blocks
LOOKUPS = 1 << 18        # machine words of one set of a run of look-ups
FOUND = "word string, n_near long, near string, near_n long"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n of the words of all texts: maximal runs of letters, A-Z lowered, with one code point deleted where 199 divides the crc32 of ``<doc_id>:<run>``."""
    # A run shorter than a word may be can only get shorter.
    runs = F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(f"({LETTERS}{{{shortest},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    rows = rows.select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (h % F.char_length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    words = rows.select(F.when(h % CUT == 0, cut).otherwise(F.col("_run")).alias("word")).filter(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _blocked(words: DataFrame, shortest: int) -> DataFrame:
    """A row for each block of a word: length (of its shorter words), side, half, word, n."""
    size, entry = F.char_length("word"), []
    for less in (0, 1):
        length = size - less
        first = F.floor(length / 2).cast("int")
        for side, half in ((0, F.substring("word", F.lit(1), first)), (1, F.substring("word", size - (length - first) + 1, length - first))):
            entry.append(F.when(length >= shortest, F.struct(length.alias("length"), F.lit(side).alias("side"), half.alias("half"))))
    return words.select("word", "n", F.explode(F.array_compact(F.array(*entry))).alias("b")).select("b.*", "word", "n")


def _cells(blocks: DataFrame, most: int) -> DataFrame:
    """Blocks of two words or more with the cell they meet in: cell, and whether the row is looked up (``asks``) and indexed (``listed``)."""
    key = ["length", "side", "half"]
    sizes = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = blocks.join(sizes, key)
    slices = F.ceil(F.col("size") / most).cast("int")
    mine = F.pmod(F.xxhash64("word"), slices).cast("int")

    def cell(i: Column, j: Column, asks: Column, listed: Column) -> Column:
        return F.struct((i * slices + j).alias("cell"), asks.alias("asks"), listed.alias("listed"))

    yes, no = F.lit(True), F.lit(False)
    every = F.sequence(F.lit(0), slices - 1)
    asked = F.transform(every, lambda j: cell(mine, j, yes, j == mine))
    listed = F.transform(F.filter(every, lambda i: i != mine), lambda i: cell(i, mine, no, yes))
    cells = F.when(slices == 1, F.array(cell(F.lit(0), F.lit(0), yes, yes))).otherwise(F.concat(asked, listed))
    return rows.select(*key, "word", "n", F.explode(cells).alias("c")).select(*key, "c.*", "word", "n")


def _letters(words: list[str], size: int) -> np.ndarray:
    """Code points of words, a row each, 0 beyond their end."""
    wide = np.array(words, dtype=f"<U{size}")
    return wide.view(np.uint32).reshape(len(words), size)


def _lookups(sizes, letters, bits, planes, listed, length, side):
    """For each look-up the bits of its near words. ``bits`` are the machine words of its block; ``planes[j]`` the letter sets of position j; ``letters[j]`` its letters."""
    first, positions = length // 2, length + 1
    equal = listed["all"][bits]
    one = np.zeros_like(equal)
    more = less = ended = apart = one
    empty = np.zeros(1, np.uint64)
    for j in range(int(sizes.max(initial=0))):
        letter = letters[j]
        here = planes[j][letter[:, None], bits]
        ahead = planes[j + 1][letter[:, None], bits] if j + 1 < positions else empty
        behind = planes[j - 1][letter[:, None], bits] if j else empty
        if j < length:
            one = (one & here) | (equal & ~here)
            more = (more | equal) & ahead
        less = (less & behind) | equal
        equal = equal & here
        if j == length - 1:
            ended = equal
        if j + 1 == first:
            apart = equal
    short = (sizes == length)[:, None]
    near = np.where(short, (one & listed["short"][bits]) | ((more | ended) & listed["long"][bits]), less & listed["short"][bits])
    return near & ~apart if side else near


def _search(length: int, side: int, block: np.ndarray, words: list[str], n: np.ndarray, asks: np.ndarray, lists: np.ndarray) -> pa.RecordBatch:
    """Look-ups of a run of blocks of one length and side; rows of a block lie together, in order of falling counts."""
    codes = _letters(words, length + 1)
    alphabet, at = np.unique(codes, return_inverse=True)
    at = at.reshape(codes.shape)
    sizes = (codes != 0).sum(axis=1)
    start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    rows = np.diff(np.append(start, len(block)))
    width = (rows + 63) // 64
    begin = np.cumsum(width) - width
    place = np.arange(len(block)) - np.repeat(start, rows)
    own = np.repeat(begin, rows) + place // 64
    bit = np.uint64(1) << (place % 64).astype(np.uint64)
    total = int(width.sum())
    planes = np.zeros((length + 1, len(alphabet), total), np.uint64)
    for j in range(length + 1):
        some = (sizes > j) & lists
        np.bitwise_or.at(planes[j], (at[some, j], own[some]), bit[some])
    listed = {name: np.zeros(total, np.uint64) for name in ("all", "short", "long")}
    for name, some in (("all", lists), ("short", lists & (sizes == length)), ("long", lists & (sizes == length + 1))):
        np.bitwise_or.at(listed[name], own[some], bit[some])
    at_row = np.repeat(start, rows)
    wide, out = np.repeat(width, rows), []
    for w in np.unique(width).tolist():
        queries = np.flatnonzero(asks & (wide == w))
        step = max(1, LOOKUPS // w)
        for low in range(0, len(queries), step):
            q = queries[low:low + step]
            bits = (own[q] - place[q] // 64)[:, None] + np.arange(w)
            near = _lookups(sizes[q], at[q].T, bits, planes, listed, length, side)
            count = np.bitwise_count(near).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(count)
            near, q = near[hit], q[hit]
            lead = (near != 0).argmax(axis=1)
            lowest = near[np.arange(len(hit)), lead]
            lowest = np.bitwise_count((lowest & (~lowest + np.uint64(1))) - np.uint64(1))
            out.append((q, count[hit], at_row[q] + 64 * lead + lowest))
    q, count, best = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
    texts = np.array(words, dtype=object)
    return pa.RecordBatch.from_arrays([pa.array(texts[q], pa.string()), pa.array(count, pa.int64()), pa.array(texts[best], pa.string()), pa.array(n[best], pa.int64())],
                                      names=["word", "n_near", "near", "near_n"])


def _runs(rows: pa.Table):
    """Whole blocks of one length and side whose letter sets stay within ``PLANE_BYTES``, at least one block each."""
    length, side, cell = (rows.column(c).to_numpy() for c in ("length", "side", "cell"))
    half = rows.column("half").combine_chunks().dictionary_encode().indices.to_numpy()
    new = np.ones(len(length), dtype=bool)
    new[1:] = (length[1:] != length[:-1]) | (side[1:] != side[:-1]) | (half[1:] != half[:-1]) | (cell[1:] != cell[:-1])
    block = np.cumsum(new) - 1
    start = np.append(np.flatnonzero(new), len(new))
    width = (np.diff(start) + 63) // 64
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    asks, lists = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "listed"))
    low = 0
    while low < len(width):
        a, most = start[low], PLANE_BYTES // (8 * 40 * (int(length[start[low]]) + 1))
        high, total = low + 1, width[low]
        while high < len(width) and total + width[high] <= most and length[start[high]] == length[a] and side[start[high]] == side[a]:
            total, high = total + width[high], high + 1
        b = start[high]
        yield _search(int(length[a]), int(side[a]), block[a:b], words[a:b], n[a:b], asks[a:b], lists[a:b])
        low = high


def _searched(batches):
    """Near words of each run of whole blocks; the last block of a batch waits for the next."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        last = [rows.column(c)[-1] for c in ("length", "side", "half", "cell")]
        same = np.ones(len(rows), dtype=bool)
        for c, value in zip(("length", "side", "half", "cell"), last, strict=True):
            same &= pc.equal(rows.column(c), value).to_numpy()
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield from _runs(rows.slice(0, cut).combine_chunks())
        held = rows.slice(cut)
    if held is not None and len(held):
        yield from _runs(held.combine_chunks())


def near_words(words: DataFrame, shortest: int = SHORTEST, most: int = BLOCK) -> DataFrame:
    """word, n_near, near (of largest count, then smallest), near_n of the words of ``words`` (word, n; distinct) that have a near word."""
    rows = _cells(_blocked(words, shortest), most)
    key = ["length", "side", "half", "cell"]
    rows = rows.repartition(*key).sortWithinPartitions(*key, F.desc("n"), "word").select(*key, "asks", "listed", "word", "n")
    found = rows.mapInArrow(_searched, FOUND)
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return found.select("word", "n_near", F.col("first.near").alias("near"), (-F.col("first.less")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms of each word that has one. Counts rise along a chain, so it ends; each round doubles the steps."""
    found = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        steps = materialise(found.join(on, "root", "left"))
        found = steps.select("word", F.coalesce("_next", "root").alias("root"))
        if not steps.filter("_next is not null").limit(1).count():
            return found


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES, most: int = BLOCK) -> DataFrame:
    """One row per word of the corpus: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest count (ties: the smallest in code-point order) if that is at least ``times`` its own, else null; its root is
    the end of the chain of forms, itself without one. Null and empty texts have no words; a null id counts as the empty text where words are altered. Repeated rows
    count each time; a table without words gives an empty table; other columns are not read.
    """
    words = materialise(word_counts(docs, doc_id, text, shortest, least))
    found = words.join(near_words(words, shortest, most), "word", "left")
    formed = F.col("near_n") >= times * F.col("n")
    rows = materialise(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"),
                                    F.when(formed, F.col("near_n")).alias("form_n")))
    roots = _roots(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
