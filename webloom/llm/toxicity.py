"""Toxicity by a weighted finite-state pattern grammar. Words are read as classes (insult, threat, target, negation, reported speech, ...);
small transducers for negation, reported speech, threats and insults are composed into one, which rewrites a clause's classes to what the
clause does. A document is scored by its matched clauses, not by its words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import materialise, one_text_an_id, small_batches, table

# Word classes of the grammar, English, German, French and Spanish. Fixed values.
INSULTS = """idiot idiots moron morons imbecile cretin scum loser losers stupid worthless disgusting pathetic vermin scumbag bastard bitch asshole
dimwit halfwit retard depp trottel idioten abschaum versager dreckskerl arschloch crétin abruti imbécile connard salaud ordure minable
idiota imbécil estúpido escoria asqueroso cabrón""".split()
# Words that insult a target and are harmless of anything else. Fixed values.
DOUBTFUL = "clown clowns dumb fool trash garbage filth parasite jerk freak pig pigs coward basura inútil".split()
THREATS = """kill killing murder hurt beat destroy shoot stab strangle hang burn crush töten umbringen vernichten schlagen
tuer frapper détruire égorger matar golpear destruir""".split()
TARGETS = """you yours yourself he she they them him these those everyone du dich dir ihr euch sie er
tu toi vous votre il elle ils elles usted ustedes él ella ellos vosotros""".split()
# Whose something is: a target of an insult near by, but of a threat only as a clause's last word ("kill her"). Fixed values.
POSSESSIVES = "your his her their".split()
NEGATIONS = """not never no isn't aren't wasn't don't doesn't didn't neither nor without nicht kein keine keinen nie ne pas
jamais aucun nunca ningún jamás sin""".split()
REPORTS = """said says say wrote writes reported reports quoted quotes claimed claims called calls according alleged sagte
sagt schrieb berichtete nannte dit écrit déclaré appelé selon dijo dice escribió llamó según""".split()
# What a threatening verb is harmless beside. Fixed values.
PLAY = """chess game games match matches cards quiz race league tournament football tennis poker contest competition debate election
schach spiel rennen turnier échecs jeu partie course tournoi ajedrez juego partido carrera torneo""".split()

#: Symbol of a class; a clause ends at "|", and every other word is ".".
CODES = {b"I": INSULTS, b"A": DOUBTFUL, b"H": THREATS, b"T": TARGETS, b"P": POSSESSIVES, b"N": NEGATIONS, b"R": REPORTS, b"G": PLAY}
OTHER, CLAUSE_END = b".", b"|"
# What may be joined to a target by an apostrophe. Fixed values.
CLITICS = ("re", "s", "ve", "ll", "d", "m")
#: What a clause can be found to do, the heaviest first, and the symbol that the composed transducer writes for it. A clause is what its
#: heaviest reading does: a threat, an insult with its target, an insult, a doubtful word alone, or one of these denied or reported.
KINDS = {"threat": "K", "targeted": "S", "insult": "U", "slight": "a", "reported": "r", "negated": "n"}


class Transducer:
    """A weighted finite-state transducer over single symbols: arcs (state, read, written, weight, next state), from state 0; all but ``open``
    states are final. Weights add up along a path, and of all paths the heaviest counts."""

    def __init__(self, arcs: list[tuple[int, str, str, float, int]], open_states: frozenset[int] = frozenset()):
        self.open = open_states
        self.arcs: dict[int, dict[str, list[tuple[str, float, int]]]] = {}
        for state, read, written, weight, following in arcs:
            self.arcs.setdefault(state, {}).setdefault(read, []).append((written, weight, following))

    def compose(self, other: Transducer) -> Transducer:
        """What ``other`` makes of what this one writes, as one transducer of the pairs of states that can be reached."""
        numbers, todo, arcs, unfinished = {(0, 0): 0}, [(0, 0)], [], set()
        while todo:
            pair = todo.pop()
            if pair[0] in self.open or pair[1] in other.open:
                unfinished.add(numbers[pair])
            for read, steps in self.arcs.get(pair[0], {}).items():
                for middle, weight, one in steps:
                    for written, more, two in other.arcs.get(pair[1], {}).get(middle, ()):
                        if (one, two) not in numbers:
                            numbers[one, two] = len(numbers)
                            todo.append((one, two))
                        arcs.append((numbers[pair], read, written, weight + more, numbers[one, two]))
        return Transducer(arcs, frozenset(unfinished))

    def best(self, symbols: str) -> tuple[float, set[str]]:
        """Weight of the heaviest path over ``symbols`` and the symbols that it writes (of equally heavy paths, one rule for all decides); no path:
        weight 0 and nothing. A path is kept as its weight and a set of bits, so a clause may be as long as it likes."""
        paths = {0: (0.0, 0)}
        for c in symbols:
            ahead: dict[int, tuple[float, int]] = {}
            for state, (weight, seen) in paths.items():
                for written, more, following in self.arcs.get(state, {}).get(c, ()):
                    got = (weight + more, seen | 1 << ord(written))
                    if got > ahead.get(following, (-1.0, 0)):
                        ahead[following] = got
            paths = ahead
        weight, seen = max((path for state, path in paths.items() if state not in self.open), default=(0.0, 0))
        return weight, {chr(k) for k in range(seen.bit_length()) if seen >> k & 1}


def _copies(state: int, symbols: str, following: int) -> list[tuple[int, str, str, float, int]]:
    return [(state, c, c, 0.0, following) for c in symbols]


def negation(reach: int = 4) -> Transducer:
    """An insult or threat at most ``reach`` words after a negation, and its like in a row with it, is denied ("n")."""
    arcs = _copies(0, "IAHTPRG.", 0) + _copies(0, "N", reach)
    for left in range(1, reach + 1):
        arcs += _copies(left, "N", reach) + _copies(left, "TPRG.", left - 1) + [(left, c, "n", 0.0, left) for c in "IAH"]
    return Transducer(arcs)


def reported_speech() -> Transducer:
    """Insults and threats after a verb of saying, up to the clause's end, are reported ("r")."""
    return Transducer(_copies(0, "IAHTPNG.n", 0) + _copies(0, "R", 1) + _copies(1, "TPNRG.n", 1) + [(1, c, "r", 0.0, 1) for c in "IAH"])


def threats(reach: int = 3) -> Transducer:
    """A threat ("K") is a threatening verb with its target at most ``reach`` words on, in a clause that speaks of no game. States: 0 nothing yet, 1 to
    ``reach`` words to the target, then all found; -1: a game was named before. The path that guesses a threat wrongly ends in an open state or in none."""
    found, game, last = reach + 1, reach + 2, reach + 3
    plain = "IATPNR.nr"
    arcs = _copies(0, plain + "H", 0) + _copies(0, "G", game) + _copies(game, plain + "HG", game)
    arcs += [(0, "H", "K", 4.0, 1)]
    for k in range(1, reach + 1):
        # A possessive is a target only if nothing follows.
        arcs += _copies(k, "T", found) + _copies(k, "P", last) + (_copies(k, "IAPNR.nrH", k + 1) if k < reach else [])
    arcs += _copies(found, plain + "H", found)
    return Transducer(arcs, frozenset(range(1, reach + 1)))


def insults(reach: int = 4) -> Transducer:
    """An insult or doubtful word at most ``reach`` words behind or before a target is aimed at it ("S"); an insult without one is still an insult
    ("U"), a doubtful word without one a slight ("a"). States: 0 no target near, 1 to ``reach`` words left since a target, then guesses of a target to come."""
    other = "HNRG.nrK"
    ahead = reach + 1  # ahead + j: within reach - j words a target must come
    arcs = _copies(0, other, 0) + _copies(0, "TP", reach)
    for k in range(reach + 1):
        nearer = max(0, k - 1)
        if k:
            arcs += _copies(k, other, nearer) + _copies(k, "TP", reach) + [(k, c, "S", 2.0, nearer) for c in "IA"]
        arcs += [(k, "I", "U", 1.0, nearer), (k, "A", "a", 0.25, nearer)]
        arcs += [(k, c, "S", 2.0, ahead) for c in "IA"]
    for j in range(reach):
        state = ahead + j
        arcs += _copies(state, "TP", reach)
        if j < reach - 1:
            arcs += _copies(state, other, state + 1) + [(state, "I", "U", 1.0, state + 1), (state, "A", "a", 0.25, state + 1)]
    return Transducer(arcs, frozenset(range(ahead, ahead + reach)))


GRAMMAR = negation().compose(reported_speech()).compose(threats()).compose(insults())


def clause_kind(symbols: str) -> str | None:
    """What a clause, as a string of classes, does: the heaviest of its matches."""
    out = GRAMMAR.best(symbols)[1]
    return next((kind for kind, c in KINDS.items() if c in out), None)


_remembered = lru_cache(maxsize=50_000)(clause_kind)


#: More words than any transducer's reach: longer runs of unmarked words within a clause are read as so many. Clauses up to LONG symbols are remembered.
RUN, LONG = 6, 200
_RUNS = re.compile(rb"\.{%d,}" % RUN)
_CLAUSES = re.compile(rb"[^|]*[IAH][^|]*")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
PREFIXES = range(3, 9)
MEMO = 200_000
HELD_OUT = 5
#: Documents learned from at most: those of the smallest hashes among the labelled ones.
MAX_LABELLED = 20_000
#: How many terms may be learned by accident, and how many of the sure ones: what the learning rows choose from.
CHOICES = ((1.0, 1e-3), (20.0, 1e-3), (20.0, 1.0))


class Classes:
    """Class strings of texts: one code a word, a memo of words per process."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        self.fixed = {w: code for code, words in CODES.items() for w in words}
        self.memo: dict[str, bytes] = {}

    def code(self, word: str) -> bytes:
        if word == "\x01":
            return CLAUSE_END
        bare = _EDGES.sub("", word.lower().replace("\u2019", "'"))
        code = self.fixed.get(bare, OTHER)
        if code == OTHER and "'" in bare:
            head, _, clitic = bare.rpartition("'")
            code = b"N" if clitic == "t" and head.endswith("n") else b"T" if clitic in CLITICS and self.fixed.get(head) == b"T" else OTHER
        if code == OTHER and self.learned:
            sure = max([self.learned.get(f"={bare}", 0.0), *[self.learned.get(bare[:k], 0.0) for k in PREFIXES if len(bare) >= k]])
            # What could have been learned by accident convicts nobody alone: a doubtful word.
            code = b"I" if sure >= 1 else b"A" if sure > 0 else OTHER
        return code + CLAUSE_END if word[-1] in ".!?;:" else code

    def __call__(self, text: str | None) -> bytes:
        words = (text or "").replace("\n", " \x01 ").split()
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        try:
            return b"".join(map(memo.__getitem__, words))
        except KeyError:
            for w in set(words).difference(memo):
                memo[w] = self.code(w)
            return b"".join(map(memo.__getitem__, words))


def matched(codes: bytes) -> Counter:
    """How many clauses do what."""
    clauses = Counter(_RUNS.sub(b"." * RUN, c) for c in _CLAUSES.findall(codes))
    out: Counter = Counter()
    for clause, n in clauses.items():
        if kind := (_remembered if len(clause) <= LONG else clause_kind)(clause.decode()):
            out[kind] += n
    return out


#: Features: clauses that threaten, insult a target, insult, slight beyond a first time; all of them; their share of the clauses; whether there are several.
#: What is denied or reported has no weight.
FEATURES, GIVEN = 7, [4.0, 3.0, 2.0, 1.0, 1.0, 0.0, 1.0, -3.0]


def _features(codes: bytes) -> list[float]:
    got = matched(codes)
    counts = [got["threat"], got["targeted"], got["insult"], max(0, got["slight"] - 1)]
    hits, clauses = sum(counts), 1 + codes.count(CLAUSE_END)
    return [*map(math.log1p, counts), math.log1p(hits), math.log1p(100 * hits / clauses), float(hits > 1)]


def _labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """The labelled documents that are not held out, at most ``MAX_LABELLED`` of them: doc_id, text, label."""
    of = F.crc32(F.col("doc_id").cast("string"))
    wanted = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (of % HELD_OUT != 0))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_LABELLED)
    )
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    # At most MAX_LABELLED ids are sent to the executors, rather than all texts to each other, and as many rows come back.
    return materialise(one_text_an_id(docs, wanted).select("text", "label", half.alias("half")))


def count_terms(labelled: DataFrame) -> DataFrame:
    """In how many documents of each label each half of the sample has a term (after ``=`` a word, else the beginning of words), and the first and last word that
    a beginning is of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[int, int], Counter] = {(h, y): Counter() for h in (0, 1) for y in (0, 1)}
            low, high = {}, {}
            for text, label, half in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = {_EDGES.sub("", w) for w in (text or "").lower().split()}
                own = {f"={w}" for w in words if len(w) > 2}
                for w in words:
                    for k in PREFIXES:
                        if len(w) >= k:
                            p = w[:k]
                            own.add(p)
                            low[p], high[p] = min(low.get(p, w), w), max(high.get(p, w), w)
                counts[half, int(label)].update(own)
            for half in (0, 1):
                one, zero = counts[half, 1], counts[half, 0]
                terms = list(one | zero)
                columns = [pa.array(terms, pa.string()), pa.array([half] * len(terms), pa.int32()), *[pa.array([c[t] for t in terms], pa.int64()) for c in (one, zero)]]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([ends.get(t) for t in terms], pa.string()) for ends in (low, high)]], names=["term", "half", "one", "zero", "low", "high"])

    counted = labelled.select("text", "label", "half").mapInArrow(run, "term string, half int, one long, zero long, low string, high string")
    return materialise(counted.groupBy("term", "half").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"), F.min("low").alias("low"), F.max("high").alias("high")))


def learn_terms(counted: DataFrame, ones: int, zeros: int, accidents: float, sure: float) -> dict[str, float]:
    """Terms that mark label 1, of which there are ``ones`` documents beside ``zeros``: found in it almost only, and so much more often than in label 0 that of all
    the terms there are ``accidents`` at most are expected to reach as much by accident, however many terms there are. The value is 1 or more where not
    even ``sure`` of them is expected to, less for the others. Their number is bounded by the sample (``MAX_LABELLED`` documents) alone. A beginning counts if
    several words have it."""
    if not ones or not zeros:
        return {}
    whole = counted.groupBy("term").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"), F.min("low").alias("low"), F.max("high").alias("high"))
    # G-test of the split against the base rate, one degree of freedom: a term reaches g by accident in about exp(-g / 2) of cases.
    share = ones / (ones + zeros)
    gain = F.expr(f"2 * one * ln(one / ((one + zero) * {share})) + CASE WHEN zero > 0 THEN 2 * zero * ln(zero / ((one + zero) * {1 - share})) ELSE 0 END")
    marked = whole.where("one > 0 AND zero <= 0.05 * one AND (low IS NULL OR low < high)").withColumn("gain", gain)
    terms = whole.count()
    least, certain = 2 * math.log(max(1.0, terms / accidents)), 2 * math.log(max(1, terms) / sure)
    return {r.term: r.gain / certain for r in marked.where(F.col("gain") > least).collect()}


def fit_weights(features: np.ndarray, labels: np.ndarray, epochs: int = 400, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by full-batch gradient descent: means, scales, weights with the bias last. No feature gets a weight below 0, so
    that more matched clauses never lower a score."""
    mean, scale = features.mean(0), features.std(0) + 1e-6
    x = np.c_[(features - mean) / scale, np.ones(len(features))]
    w = np.zeros(x.shape[1])
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * (x.T @ (p - labels) / len(labels) + l2 * np.r_[w[:-1], 0])
        w[:-1] = np.maximum(w[:-1], 0)
    return mean, scale, w


def teach(sample: DataFrame) -> tuple[dict[str, float], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Learned terms, and means, scales and weights of the features, from a sample (text, label, half).

    What terms tell of the documents that they come from says too much of them. So each half is described with the terms of the other half, weights are fitted on such
    rows alone, and of CHOICES the one counts by which each half's weights tell the other half's labels best, by log-loss. The terms that are used in the end come from
    both halves. Held-out rows have no part in any of this."""
    sizes = {(r.half, r.label): r.n for r in sample.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    given = np.zeros(FEATURES), np.ones(FEATURES), np.array(GIVEN)
    counted = count_terms(sample)
    size = lambda label, *halves: sum(sizes.get((h, label), 0) for h in halves)
    if not all(sizes.get((h, y)) for h in (0, 1) for y in (0, 1)):
        return learn_terms(counted, size(1, 0, 1), size(0, 0, 1), *CHOICES[0]), given
    others = [[learn_terms(counted.where(F.col("half") != half), size(1, 1 - half), size(0, 1 - half), *choice) for half in (0, 1)] for choice in CHOICES]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [[Classes(terms) for terms in halves] for halves in others]
        for batch in batches:
            rows = [[x for halves in codes for x in _features(halves[half](text))] for text, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "label", "half"])

    taught = sorted(sample.select("text", "label", "half").mapInArrow(describe, "x array<double>, label int, half int").collect())
    x = np.array([r.x for r in taught]).reshape(len(taught), len(CHOICES), FEATURES)
    y, half = np.array([r.label for r in taught], float), np.array([r.half for r in taught])

    def loss(k: int) -> float:
        total = 0.0
        for test in (0, 1):
            mean, scale, w = fit_weights(x[half != test, k], y[half != test])
            z = np.clip(((x[half == test, k] - mean) / scale) @ w[:-1] + w[-1], -30, 30)
            total += float(np.sum(np.logaddexp(0, z) - y[half == test] * z))
        return total

    k = min(range(len(CHOICES)), key=loss)
    return learn_terms(counted, size(1, 0, 1), size(0, 0, 1), *CHOICES[k]), fit_weights(x[:, k], y)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every whole text: its clauses that the composed transducer matches, weighted as the labelled documents teach.

    Learned from at most ``MAX_LABELLED`` labelled documents with crc32(doc_id as text) mod 5 other than 0: insult terms that
    extend the fixed classes, and the weights of the matches. A label given twice: the higher one; an id that several rows have: learned from one of them. Null doc_id: not held out, never learned from. Null or empty text: the score of a text without matches. No usable
    label, or labels of one kind: only the fixed classes and given weights. Very long text: whole. Repeated rows: scored alike. Empty table: no rows. Extra
    columns are ignored. Returns doc_id, held_out, score, predicted (1 from 0.5 on).
    """
    learned, (mean, scale, w) = teach(_labelled(small_batches(docs), labels, "toxic"))
    codes = Classes(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([_features(codes(t)) for t in batch.column(2).to_pylist()]).reshape(batch.num_rows, len(mean))
            z = ((x - mean) / scale) @ w[:-1] + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "held_out", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
