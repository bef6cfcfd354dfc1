"""Near-duplicate documents by bottom-k sketches of one hash function.

1. A document's set of word shingles is hashed; its sketch is the ``SKETCH`` smallest values. Documents
   with equal sets form a class and go on as one.
2. Inverted lists of the retained values: classes that meet in lists are candidates, and the number of lists they share is
   the overlap of their sketches. The union-sketch estimate (overlap over union of both sketches) filters them.
3. A candidate is a link when the exact Jaccard of both full sets, recomputed from the texts, reaches the threshold.
   Candidates already joined by other links need not be verified: they cannot change a component.

Long lists (more than ``LIST`` classes) are never paired in full at first. A class with at least half of its retained values in short lists
needs no long one: a partner at similarity 0.8 or more shares about nine tenths of the values, so it shares one of those (losing a
link takes a deviation of over six standard errors). For the other classes the full sets replace the sketches: a class with more than
1 - threshold of its shingles in short lists must share one with any partner. What is left are classes made almost wholly of
shingles that many share: a large family of near copies, or a passage with a few words around it. They are linked with the class
of each long list that has the least of its own, and by the triangle inequality of the Jaccard distance only those stay in the list that could still link
with a class not linked to it, whether that one is linked to others or to none. When rounds no longer help, all pairs that remain possible are
verified, but for those that links join already, so no link between classes of one list is given up.

Rows of lists are (value, class), the numbers of a class lie once in a table of classes, and the tables of a step are deleted when the next one is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import components
from tidemill.llm.tables import Scratch, without
from tidemill.llm.text import chunks, mix, words
from tidemill.session import MAX_BROADCAST_ROWS

SHINGLE = 5
SKETCH = 64
LIST = 48
ROUNDS = 6
PROBES = 16    # retained values by which classes of long lists meet; two at similarity 0.8 share each with probability of 0.8 or more
# Sketch overlap over sketch union below which a pair is not verified; 0.85 of true similarity gives about 0.78, standard error 0.06.
ESTIMATE = 0.42
CENTRES, CENTRE_BYTES = 10_000, 8 << 20   # centres whose texts may be broadcast, and their bytes
BESIDE = {"text_md5": "binary"}
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                   0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)


def shingle_sets(column, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow column; fewer words than ``size`` make one shingle."""
    for _, _, data, offsets in chunks(column):
        hashes, _, _, first = words(data, offsets)
        joined = np.zeros(max(len(hashes) - size + 1, 0), dtype=np.uint64)
        for i in range(size):
            joined += mix(hashes[i:len(hashes) - size + 1 + i] ^ _STEPS[i]) * _STEPS[-1 - i] if len(joined) else 0
        joined = mix(joined)
        for low, high in zip(first[:-1], first[1:], strict=True):
            if high - low >= size:
                yield np.unique(joined[low:high - size + 1])
            elif high > low:
                yield np.array([int.from_bytes(hashlib.blake2b(hashes[low:high].tobytes(), digest_size=8).digest(), "little")], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def _signed(values: np.ndarray) -> np.ndarray:
    return (values ^ np.uint64(1 << 63)).view(np.int64)


def _sketches(size: int, kept: int):
    def run(batches):
        for batch in batches:
            ids, counts, signs, sketches = batch.column(0), [], [], []
            for values in shingle_sets(batch.column(1), size):
                counts.append(len(values))
                signs.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                sketches.append(_signed(values[:kept]))
            ends = np.cumsum([0, *map(len, sketches)])
            sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sketches) if sketches else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(signs, pa.binary()), sketch, *batch.columns[2:]],
                                             names=["doc_id", "n", "sign", "sketch", *batch.schema.names[2:]])
    return run


def _full_lists(size: int):
    def run(batches):
        for batch in batches:
            sets, ids, extra = [], [], []
            for i, values in enumerate(shingle_sets(batch.column("text"), size)):
                sets.append(_signed(values))
                ids.append(np.full(len(values), batch.column("rep")[i].as_py(), np.int64))
                extra.append(np.full(len(values), len(values), np.int64))
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sets, ids, extra)], names=["v", "rep", "n"])
    return run


def _verify(size: int):
    def run(batches):
        for batch in batches:
            sizes, common = [], []
            for x, y in zip(shingle_sets(batch.column("text_a"), size), shingle_sets(batch.column("text_b"), size), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                common.append(both)
                sizes.append(len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(sizes, pa.int64())],
                                             names=["a", "b", "common", "joint"])
    return run


class _Linker:
    """Verifies candidate pairs of classes and gathers the links."""

    def __init__(self, texts: DataFrame, percent: int, size: int, scratch: Scratch):
        self.texts, self.percent, self.size, self.scratch = texts, percent, size, scratch
        self.links: list[DataFrame] = []
        self.joined: DataFrame | None = None

    def measured(self, pairs: DataFrame) -> DataFrame:
        """a, b, common, joint of ``pairs`` (a, b; written), from the full sets.

        Where the texts of all a together are within ``CENTRE_BYTES``, as those of a few centres are, they are broadcast and the texts of b stay where they are; else the
        texts meet through two joins, each of which can be split."""
        few = pairs.count() <= MAX_BROADCAST_ROWS  # two numbers a row; else the texts are shuffled once a side
        hint = F.broadcast if few else (lambda df: df)
        a = self.texts.join(hint(pairs.select(F.col("a").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        b = self.texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        centres = None
        if few and pairs.select("a").distinct().count() <= CENTRES:
            centres = self.scratch.keep(a.dropDuplicates(["a"]))
            bytes_ = centres.agg(F.coalesce(F.sum(F.octet_length("text_a")), F.lit(0))).first()[0]
        if centres is not None and bytes_ <= CENTRE_BYTES:
            both = b.join(hint(pairs), "b").join(F.broadcast(centres), "a")
        else:
            b = b.join(hint(pairs.select("b").distinct()), "b", "left_semi") if few else b
            both = a.join(hint(pairs), "a").join(b, "b")
        found = self.scratch.keep(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(self.size), "a long, b long, common long, joint long"))
        if centres is not None:
            self.scratch.free(centres)
        return found

    def add(self, measured: DataFrame) -> DataFrame:
        """Keep the links among measured pairs."""
        links = self.scratch.keep(measured.filter(f"100 * common >= {self.percent} * joint").select("a", "b").distinct())
        self.links.append(links)
        return links

    def link(self, pairs: DataFrame) -> None:
        """First the most overlapping smaller partner of each class; then the pairs whose ends these links do not join yet."""
        keep, free = self.scratch.keep, self.scratch.free
        pairs = keep(pairs)
        first = keep(pairs.groupBy("b").agg(F.max_by("a", F.struct(F.col("shared"), -F.col("a"))).alias("a")).select("a", "b"))
        met = self.measured(first)
        found = self.add(met).select(F.col("b").alias("node"), F.col("a").alias("up"))
        free(met)
        # Each link leads to a smaller class; three steps of pointer doubling reach the end of most chains. Any pair this leaves apart is verified.
        for _ in range(3):
            above = found.select(F.col("node").alias("up"), F.col("up").alias("next"))
            found = found.join(above, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
        found = keep(found)
        rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
        rest = rest.join(found.select(F.col("node").alias("a"), F.col("up").alias("_a")), "a", "left")
        rest = rest.join(found.select(F.col("node").alias("b"), F.col("up").alias("_b")), "b", "left")
        rest = keep(rest.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b"))
        free(pairs, first, found)
        if rest.limit(1).count():
            met = self.measured(rest)
            self.add(met)
            free(met)
        free(rest)

    def components(self) -> DataFrame:
        links = self.links[0]
        for more in self.links[1:]:
            links = links.unionByName(more)
        return components(links)

    def settled(self) -> DataFrame:
        """The components of the links so far (node, component), which from now on stand for them."""
        found = self.scratch.keep(self.components())
        self.scratch.free(*self.links, self.joined)
        self.joined, self.links = found, [found.select(F.col("node").alias("a"), F.col("component").alias("b"))]
        return found


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that meet in lists: a, b, shared (number of lists), with the sketch sizes and hot counts of both."""
    x = rows.select("v", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("size").alias("sa"), F.col("hot").alias("ha"))
    y = rows.select("v", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("size").alias("sb"), F.col("hot").alias("hb"))
    near = x.join(y, "v").filter(f"a < b and 100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), *(F.first(c).alias(c) for c in ("sa", "sb", "ha", "hb")))


def _estimated(pairs: DataFrame, estimate: float) -> DataFrame:
    """Pairs whose sketches, hot values counted as shared as far as possible, overlap enough."""
    upper = F.col("shared") + F.least("ha", "hb")
    return pairs.filter(upper >= estimate * (F.col("sa") + F.col("sb") - upper)).select("a", "b", "shared")


def _split(lists: DataFrame, limit: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of lists with two classes or more: the short ones with each class's number of long lists, and the long ones; and the table both are read from.

    A class in no short list keeps its count of long ones in the second frame.
    """
    lengths = lists.groupBy("v").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    rows = scratch.keep(lists.join(lengths, "v"))
    long = rows.filter(F.col("length") > limit).drop("length")
    hot = long.groupBy("rep").agg(F.count(F.lit(1)).alias("hot"))
    short = rows.filter(F.col("length") <= limit).drop("length").join(hot, "rep", "left").fillna(0, ["hot"])
    return short, long.join(hot, "rep"), rows


def _stars(lists: DataFrame, classes: DataFrame, linker: _Linker, percent: int, rounds: int) -> None:
    """Link classes of long lists: ``lists`` has rows (v, rep) of classes that no short list can settle, ``classes`` (rep, n, own) their numbers, written
    once; ``own`` counts shingles few others have.

    The class of a list with the least of its own comes nearest to what the list has in common, so it links with most others. Classes that links of any list join
    have one label and need not meet. A class stays in a list only while its distance to the centre leaves room for a link with a class of another
    label; the centre itself, measured with all that can be near it, goes. Rounds end when they no longer take out a quarter of the rows, or after ``rounds``; of what
    is left all pairs of different labels that the numbers allow are verified.
    """
    reach, keep, free = 1 - percent / 100, linker.scratch.keep, linker.scratch.free
    rows = lists
    left = rows.count()
    known = linker.settled() if left else None
    for _ in range(rounds):
        if not left:
            return
        numbers = keep(classes.join(known.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", "own", F.coalesce("component", "rep").alias("label")))
        full = rows.join(numbers, "rep")
        centres = full.groupBy("v").agg(F.min(F.struct((F.col("label") != F.col("rep")).alias("linked"), "own", "n", "rep", "label")).alias("c"))
        centres = keep(centres.select("v", F.col("c.rep").alias("c"), F.col("c.n").alias("cn"), F.col("c.label").alias("cl")))
        met_in = rows.join(centres, "v").filter("rep <> c").join(numbers, "rep")
        sizes = F.least("cn", "n") / F.greatest("cn", "n")  # the most that sizes allow; beyond twice the reach nothing linked to one can link to the other
        near = keep(met_in.filter((F.col("label") != F.col("cl")) & (sizes >= 1 - 2 * reach - 1e-9)).select(F.col("c").alias("a"), F.col("rep").alias("b")).distinct())
        met = linker.measured(near)
        free(near)
        linker.add(met)
        known = linker.settled()
        label = known.withColumnRenamed("node", "rep")
        exact = 1 - F.col("common") / F.col("joint")
        d = met_in.drop("label").join(label, "rep", "left").withColumn("label", F.coalesce("component", "rep"))
        d = d.join(met.select(F.col("a").alias("c"), F.col("b").alias("rep"), "common", "joint"), ["c", "rep"], "left")
        # A class not measured lies somewhere between what the sizes allow and 1.
        d = keep(d.select("v", "rep", "label", F.coalesce(exact, 1 - sizes).alias("low"), F.coalesce(exact, F.lit(1.0)).alias("high")))
        # The two labels nearest to the centre tell for any class how near one of another label comes.
        by_label = d.groupBy("v", "label").agg(F.min("low").alias("low"))
        first = by_label.groupBy("v").agg(F.min(F.struct("low", "label")).alias("first"))
        second = by_label.join(first, "v").filter("label <> first.label").groupBy("v").agg(F.min("low").alias("second"))
        nearest = first.join(second, "v")  # a list of one label is settled
        other = F.when(F.col("first.label") != F.col("label"), F.col("first.low")).otherwise(F.col("second"))
        after = keep(d.join(nearest, "v").filter(other - F.col("high") <= reach + 1e-9).select("v", "rep"))
        free(met, d, centres, numbers, rows)
        rows, before, left = after, left, after.count()
        if 4 * (before - left) < before:
            break
    if not left:
        return
    rows = keep(rows.join(classes, "rep").join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")))
    # Classes that share no short list have at most the smaller of their common parts in common.
    x = rows.select("v", F.col("rep").alias("a"), F.col("label").alias("la"), (F.col("n") - F.col("own")).alias("ha"), F.col("own").alias("oa"))
    y = rows.select("v", F.col("rep").alias("b"), F.col("label").alias("lb"), (F.col("n") - F.col("own")).alias("hb"), F.col("own").alias("ob"))
    apart = x.join(y, "v").filter(f"a < b and la <> lb and 100 * least(ha, hb) >= {percent} * (greatest(ha, hb) + oa + ob)")
    pairs = keep(apart.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")))
    if pairs.limit(1).count():
        linker.link(pairs)
    free(rows, pairs)


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, size: int = SHINGLE,
               sketch: int = SKETCH, limit: int = LIST, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Linked are sets with 100 * intersection >= percent * union. Texts without words (null, empty) have an empty set and are linked
    with nothing, not even each other. Rows that repeat an id repeat its result. Null ids are rows of their own: they join the
    class of their set, and are kept only where no id is. An empty table gives an empty table; other columns are not read.
    """
    return _decided(docs, doc_id, text, percent, size, sketch, limit, rounds).select("doc_id", "n_shingles", "component_id", "kept")


def _decided(docs: DataFrame, doc_id: str, text: str, percent: int, size: int = SHINGLE, sketch: int = SKETCH, limit: int = LIST, rounds: int = ROUNDS,
             **beside: Column) -> DataFrame:
    """The rows of ``near_dedup`` with string columns of ``docs`` beside them."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(c.alias(name) for name, c in beside.items()))
    schema = ", ".join(["doc_id long, n long, sign binary, sketch array<long>", *(f"{name} {kind}" for name, kind in BESIDE.items() if name in beside)])
    scratch = Scratch(docs.sparkSession)
    keep, free = scratch.keep, scratch.free
    docs_sets = keep(source.mapInArrow(_sketches(size, sketch), schema))
    classes = keep(docs_sets.filter("n > 0").groupBy("sign").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    linker = _Linker(source.select("doc_id", "text"), percent, size, scratch)
    lists = classes.filter("rep is not null").select(F.posexplode("sketch").alias("place", "v"), "rep", "n", F.size("sketch").alias("size"))
    short, long, rows = _split(lists, limit, scratch)
    linker.link(_estimated(_candidates(short, percent), ESTIMATE))
    unsettled = keep(long.filter("2 * hot > size").select("rep").distinct())
    if unsettled.limit(1).count():
        texts = source.join(unsettled, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "text")
        full = texts.dropDuplicates(["rep"]).mapInArrow(_full_lists(size), "v long, rep long, n long").withColumn("size", F.col("n"))
        short, wide, full_rows = _split(full, limit, scratch)
        linker.link(_estimated(_candidates(short, percent), percent / 100 - 1e-9))
        last = keep(wide.filter(f"100 * hot >= {percent} * n").select("rep", "n", (F.col("n") - F.col("hot")).alias("own")).distinct())
        free(full_rows)
        if last.limit(1).count():
            probes = keep(long.filter(F.col("place") < PROBES).join(last.select("rep"), "rep", "left_semi").select("v", "rep"))
            free(rows)
            _stars(probes, last, linker, percent, rounds)
    free(rows, unsettled)
    found = docs_sets.select("doc_id", "n", "sign", *beside).join(classes.select("sign", "rep"), "sign", "left")
    found = found.join(linker.components().withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"), *beside)


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``docs`` whose document stays, all columns."""
    same = F.unhex(F.md5(F.col(text).cast("binary")))  # equal texts have equal sets, so the text tells the rows of an id apart as well as its set does
    return without(docs, _decided(docs, doc_id, text, percent, text_md5=same).select("doc_id", F.col("text_md5").alias("sign"), "kept"), doc_id, same)
