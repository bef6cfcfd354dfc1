"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is cut at sentence marks and line ends. Its words become classes (insult, threat verb, target, negation, reporting word, quote, filler), and five
small transducers, composed into one deterministic machine, rewrite the class string into events: an insult or threat, alone or
aimed at a person, under a negation or inside reported speech. The arcs of the insult transducer carry weights: beside listed words it accepts
words and stems learned from labelled texts, each weighted by its log odds. A document is described by its matched clauses: how many have each event, the heaviest
one, the weight of all. Logistic regression on labels makes a probability of it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import fold, some_rows
from tidemill.session import materialise

# The words of the classes, in English, German, French and Spanish.
LEXICON = {
    "I": """asshole bastard bitch clown coward cretin disgusting dumb dumbass fool garbage idiot idiotic idiots imbecile jerk loser losers maggot
            moron moronic morons pathetic pig rat scum scumbag shit slime stupid subhuman trash ugly vermin worthless
            arschloch abschaum blödmann depp dummkopf idioten schwachkopf trottel versager wertlos ekelhaft widerlich dumm
            abruti connard crétin débile imbécile merde minable ordure salaud stupide dégoûtant
            asqueroso basura cretino despreciable escoria estúpido idiota imbécil inútil mierda patético payaso tonto""",
    "T": """kill murder hurt destroy beat shoot stab hang burn die umbringen töten schlagen verprügeln tuer frapper crever matar golpear morir""",
    "Y": """you your yours you're youre u ya he she they them him her people those these
            du dich dir ihr euch sie tu te toi vous ils elles tú usted ustedes ellos ellas""",
    "N": """not no never isn't aren't wasn't don't doesn't didn't won't nobody without nicht kein keine nie niemals ne pas jamais aucun nunca jamás""",
    "R": """said says say claimed claims called calls quoted quote wrote writes reported reports according alleged
            sagte sagt schrieb nannte dit disait écrit dijo dice escribió""",
}
OTHER, MARK = "O", "Q"
CLASSES = "ITYNRQO"
#: What the machine writes: an insult alone (i) or aimed at a person named before it (I) or after it (a), a threat to a person (T); then under
#: a negation (n) or in reported speech (r).
EVENTS = ("i", "I", "a", "T", "in", "In", "an", "Tn", "ir", "Ir", "ar", "Tr")
REACH = 4  # words after which a target, negation or reporting word no longer bears on what follows
MAX_TRAIN_ROWS = 50_000      # labelled rows the regression learns from
MAX_LEXICON_ROWS = 12_000    # labelled rows the stems are learned from
STEM_SIZES = (4, 5, 6, 7, 8)  # letters of a stem; a whole word ends in END
END = "$"
FLUSH_TEXTS = 1000           # texts a task counts before it hands its counts on
LEAST_EVIDENCE = 40.0        # likelihood ratio (G squared) a stem needs
LISTED = 3.0                 # weight of a listed insult or threat


class Transducer:
    """A deterministic transducer: ``step(state, symbol)`` gives the next state and the symbol written."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __rshift__(self, after: Transducer) -> Transducer:
        """The composition: what this machine writes is read by ``after``."""
        def step(state, symbol):
            mine, written = self.step(state[0], symbol)
            other, out = after.step(state[1], written)
            return (mine, other), out
        return Transducer((self.start, after.start), step)

    def table(self, symbols) -> tuple[dict, list]:
        """All reachable states as numbers: (state, symbol) to (state, output)."""
        numbers, todo, moves = {self.start: 0}, [self.start], {}
        while todo:
            state = todo.pop()
            for symbol in symbols:
                new, out = self.step(state, symbol)
                if new not in numbers:
                    numbers[new] = len(numbers)
                    todo.append(new)
                moves[numbers[state], symbol] = (numbers[new], out)
        return moves, list(numbers)


def _insults() -> Transducer:
    return Transducer(0, lambda state, symbol: (0, "i" if symbol == "I" else symbol))


def _threats() -> Transducer:
    """A threat verb is one only when a person is named shortly before it or next; else it is filler."""
    def step(state, symbol):
        person, verb = max(state[0] - 1, 0), max(state[1] - 1, 0)
        if symbol == "Y":
            return (REACH, 0), "T" if verb else symbol
        if symbol == "T":
            return ((person, 0), symbol) if person else ((0, 2), OTHER)
        return (person, verb), symbol
    return Transducer((0, 0), step)


def _targets() -> Transducer:
    """An insult shortly after a person, or a person shortly after an insult, is an aimed insult."""
    def step(state, symbol):
        person, insult = max(state[0] - 1, 0), max(state[1] - 1, 0)
        if symbol == "i":
            return (person, REACH), "I" if person else symbol
        if symbol == "Y":
            return (REACH, 0), "a" if insult else symbol
        return (person, insult), symbol
    return Transducer((0, 0), step)


def _negated() -> Transducer:
    def step(state, symbol):
        left = max(state - 1, 0)
        if symbol == "N":
            return REACH, symbol
        return left, symbol + "n" if symbol in "iIaT" and left else symbol
    return Transducer(0, step)


def _reported() -> Transducer:
    """After a reporting word, and between quotes, insults and threats are someone else's."""
    def step(state, symbol):
        open_, left = state
        left = max(left - 1, 0)
        if symbol == MARK:
            return (not open_, left), symbol
        if symbol == "R":
            return (open_, 2 * REACH), symbol
        if symbol[0] in "iIaT" and (open_ or left):
            return (open_, left), symbol[0] + "r"
        return (open_, left), symbol
    return Transducer((False, 0), step)


@lru_cache(1)
def machine():
    """The composed grammar: insults, threats, targets, negation, reported speech."""
    whole = _insults() >> _threats() >> _targets() >> _negated() >> _reported()
    moves, _ = whole.table(CLASSES)
    return moves


_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[\"“”«»„]")
_WORD = re.compile(r"[^\W\d_]+")
_CUT = re.compile(r"[.!?;\n]+(?=\s|$)|\n")
WIDTH = len(EVENTS) + 4


class Grammar:
    """The lexicon with weighted insult arcs: listed words, and ``stems`` that a word may begin with, or be where they end in ``END``."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self._ready = False

    def __getstate__(self):
        return {"stems": self.stems, "_ready": False}

    def _build(self):
        self.classes = {word: c for c, words in LEXICON.items() for word in words.split()}
        self.sizes = sorted({len(x) for x in self.stems if not x.endswith(END)}, reverse=True)
        self.first = ahocorasick.Automaton()
        for word, c in self.classes.items():
            if c in "IT":
                self.first.add_word(word, len(word))
        for stem in self.stems:
            self.first.add_word(stem.rstrip(END), len(stem.rstrip(END)))
        self.first.make_automaton()
        self._ready = True

    def arc(self, token: str) -> tuple[str, float]:
        """The class of a word and the weight of its arc."""
        token = token.replace("’", "'")
        found = self.classes.get(token, OTHER)
        if found in "IT":
            return found, LISTED
        for stem in (token + END, *(token[:n] for n in self.sizes)):
            if stem in self.stems:
                return "I", self.stems[stem]
        return found, 0.0

    def events(self, clause: str) -> list[tuple[str, float]]:
        """The events of one lower-case clause with the weights of their words."""
        if not self._ready:
            self._build()
        moves, state, events, last = machine(), 0, [], 0.0
        for token in _TOKEN.findall(clause):
            symbol, weight = self.arc(token) if token[0].isalnum() else (MARK, 0.0)
            state, out = moves[state, symbol]
            last = weight or last
            if out in EVENTS:
                events.append((out, weight if weight else last * 0.5))
        return events

    def features(self, text: str | None) -> np.ndarray:
        """Per event the clauses that have it (log), then the heaviest clause, the weight of all (log), matched clauses (log) and words (log)."""
        if not self._ready:
            self._build()
        out = np.zeros(WIDTH, np.float32)
        text = (text or "").lower()
        hits = [end for end, n in self.first.iter(text) if end < n or not text[end - n].isalnum()]
        if not hits:
            return out
        cuts = [m.end() for m in _CUT.finditer(text)] + [len(text)]
        seen, most, matched, total = Counter(), 0.0, 0, 0.0
        for i in sorted({bisect_right(cuts, end) for end in hits}):
            i = min(i, len(cuts) - 1)
            events = self.events(text[cuts[i - 1] if i else 0:cuts[i]])
            if events:
                matched += 1
                weight = sum(w for _, w in events)
                most, total = max(most, weight), total + weight
                seen.update({e for e, _ in events})
        if matched:
            out[:len(EVENTS)] = [np.log1p(seen[e]) for e in EVENTS]
            out[len(EVENTS):] = np.log1p(most), np.log1p(total), np.log1p(matched), np.log1p(len(text)) / 5
        return out


def _stem_counts(batches):
    """Of a task's labelled texts: how many toxic and other ones have a word that begins with each stem."""
    def handed(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[1] for c in counts.values()], pa.int64()),
                                           pa.array([c[0] for c in counts.values()], pa.int64())], names=["stem", "toxic", "other"])
    counts, texts = {}, 0
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            words = set(_WORD.findall(text.lower()))
            for stem in {w[:n] for w in words for n in STEM_SIZES if len(w) >= n} | {w + END for w in words}:
                counts.setdefault(stem, [0, 0])[1 if y else 0] += 1
            texts += 1
            if texts % FLUSH_TEXTS == 0:
                yield handed(counts)
                counts = {}
    if counts:
        yield handed(counts)


def choose_stems(rows: list[tuple[str, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Of (stem, toxic texts, other texts) those with the strongest evidence among the stems they begin with or begin; with log odds."""
    def evidence(a, b):
        rate = (a + b) / (toxic + other)
        parts = ((a, toxic * rate), (b, other * rate), (toxic - a, toxic * (1 - rate)), (other - b, other * (1 - rate)))
        return 2 * sum(x * np.log(x / e) for x, e in parts if x > 0 and e > 0)
    found = {}
    for stem, a, b in rows:
        odds = np.log((a + 0.5) / (toxic - a + 0.5) * (other - b + 0.5) / (b + 0.5))
        if odds > 2.5 and (g := evidence(a, b)) >= LEAST_EVIDENCE:
            found[stem] = (float(g), float(odds))
    best = {}
    for stem in sorted(found, key=lambda x: (-found[x][0], -len(x), x)):
        if not any(stem.startswith(x) or x.startswith(stem) for x in best):
            best[stem] = found[stem][1]
    return best


def learn_stems(labelled: DataFrame) -> dict[str, float]:
    """Stems from ``labelled`` (text, y), a bounded number of rows. Texts that share the least hash of their long words count once, so
    that the words of a family of copies are no evidence."""
    long = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) >= 8)
    family = F.coalesce(F.array_min(F.transform(long, lambda w: F.xxhash64(w))), F.xxhash64("text"))
    labelled = labelled.filter("text is not null").groupBy(family.alias("family")).agg(F.max(F.struct("y", "text")).alias("one")).select("one.*")
    totals = dict((r["y"], r["count"]) for r in labelled.groupBy("y").count().collect())
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not other:
        return {}
    counts = labelled.mapInArrow(_stem_counts, "stem string, toxic long, other long").groupBy("stem").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    # Fewer toxic texts than this cannot reach the evidence, nor can a stem that is no more frequent among them.
    rows = counts.filter((F.col("a") >= 4) & (F.col("a") * F.lit(other) > 5 * F.col("b") * F.lit(toxic))).collect()
    return choose_stems([(r["stem"], r["a"], r["b"]) for r in rows], toxic, other)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, intercept first. Without both labels it starts from a bare insult being toxic."""
    # With no or few labels the prior decides: plain and aimed events speak for toxicity, negated and reported ones little.
    prior = np.array([-3.0, *(2.0 if len(e) == 1 else 0.2 for e in EVENTS), 1.0, 1.0, 0.5, 0.0])
    x = np.column_stack([np.ones(len(x)), x])
    w, scale = prior.copy(), np.full(len(prior), ridge)

    def loss(w):
        z = x @ w
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(scale * (w - prior) ** 2)
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + scale * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(scale), grad)
        size = 1.0
        while (new := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if now - new < 1e-9 * abs(now):
            break
        w, now = w - size * step, new
    return w


def _featured(grammar: Grammar):
    def run(batches):
        for batch in batches:
            x = [grammar.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "x"])
    return run


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          max_rows: int = MAX_TRAIN_ROWS, max_lexicon_rows: int = MAX_LEXICON_ROWS) -> tuple[Grammar, np.ndarray]:
    """The grammar and its weights from the labelled rows given, about ``max_rows`` of them at most, chosen by the hash of their id; null labels are left out."""
    given = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    total = given.count()
    chosen = F.broadcast(some_rows(given, "doc_id", max_rows, total))
    few = F.broadcast(some_rows(given, "doc_id", max_lexicon_rows, total))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    grammar = Grammar(learn_stems(materialise(source.join(few, "doc_id").select("text", "y"))))
    found = source.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(_featured(grammar), "doc_id long, x array<float>")
    rows = found.join(chosen, "doc_id").select("doc_id", "x", "y").orderBy("doc_id", "y").collect()
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(-1, WIDTH)
    return grammar, fit(x, np.array([r["y"] for r in rows], dtype=np.float64))


def score(docs: DataFrame, grammar: Grammar, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, clauses (matched ones) of every row. Null and empty texts score the intercept; other columns are not read."""
    def run(batches):
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch.column("text").to_pylist()], dtype=np.float64).reshape(-1, WIDTH)
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(np.rint(np.expm1(x[:, -2])).astype(np.int64))],
                names=["doc_id", "score", "predicted", "clauses"])
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int, clauses long")


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """Score every row of ``docs``, learning from labels of rows whose crc32(id) modulo 4 is not 2: doc_id, held_out, score, predicted, clauses.

    Only texts are scored: labels, language, source and id are no inputs. Repeated rows get equal scores; a null id is scored like any row and, having no
    label, teaches nothing. Without labels the weights are the grammar's own. An empty table gives an empty table.
    """
    learn = labels.filter(fold(F.col(doc_id), 4) != 2)
    grammar, weights = train(docs, learn, doc_id, text, label)
    found = score(docs, grammar, weights, doc_id, text, threshold)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "clauses")
