"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reported speech, other.
Insults come from a lexicon learned from labels (whole words and word beginnings that are far likelier in toxic
documents); the other classes are small fixed lists.  A clause's symbols then
run through the composition of three transducers:

* negation rewrites an insult or a threat soon after a negation;
* reported speech rewrites one that follows a verb of saying in its clause;
* targets rewrite one next to somebody addressed, and give every match its weight.

The composed machine is deterministic: one table look-up per word.  A clause's
strength is the sum of its matches' weights, each times the insult's lexicon
weight; a document's score is a logistic curve of the logarithm of its clauses'
total, fitted to the training labels.

Lexicon and curve are fitted on at most ``sample_rows`` labelled documents
outside the held-out part (the first by a hash of the id); that bound is the
only one: the lexicon takes every word and beginning that its sample proves, in as
many rounds as find any.  Every document is scored by its whole text, in a single pass, with
no shuffle.

Defined results: NULL and empty texts have no clause and score as such; a NULL
doc_id counts as the empty text in the fold; labels that are NULL or have no
document are left out, of repeated labels the largest counts; without labels of both
classes the lexicon is empty; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_crc, stage

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7)
ANY = ""  # a feature that every document has

# fixed values: word lists in English, German, French and Spanish
NEGATION = frozenset("not never no without isn't aren't wasn't don't doesn't didn't won't can't cannot "
                     "nicht kein keine keinen nie niemals ohne ne pas jamais aucun aucune sans nunca jamás sin".split())
REPORTED = frozenset("said says say saying wrote writes claimed claims called quoted quotes reported reportedly allegedly "
                     "sagte sagt schrieb behauptete nannte zitierte dit disait écrit appelé cité dijo dice escribió "
                     "llamó citó".split())
TARGET = frozenset("you your yours you're u ur yourself du dich dir dein deine ihr euch tu toi te ton ta vous votre tú "
                   "ti usted ustedes vos".split())
THREAT = frozenset("kill murder hurt destroy stab strangle punch beat burn töten umbringen verletzen zerstören "
                   "erwürgen tuer détruire blesser frapper matar destruir lastimar golpear".split())

OTHER, INSULT, MENACE, WHOM, NOT, SAID = range(6)
#: What a match can become on its way through the transducers.
DENIED, DENIED_MENACE, QUOTED, QUOTED_MENACE, AIMED, AIMED_MENACE = range(6, 12)
#: Weight of each kind of match in a clause.
WEIGHTS = {INSULT: 1.0, MENACE: 0.3, DENIED: 0.4, DENIED_MENACE: 0.0, QUOTED: 0.5, QUOTED_MENACE: 0.05,
           AIMED: 1.5, AIMED_MENACE: 1.2}
#: A menace has no learned weight; it counts as this much of a lexicon weight.
MENACE_WEIGHT = 2.0

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CLAUSE = re.compile(r"[.!?;:\n|]+")


class Transducer:
    """Deterministic and complete: (state, symbol) -> (state, symbol out, weight); state 0 starts."""

    def __init__(self, arcs: list[dict[int, tuple[int, int, float]]]):
        self.arcs = arcs

    def compose(self, other: Transducer) -> Transducer:
        """This one's output is the other's input; weights add up.  States are the pairs that can be reached."""
        numbers, todo, arcs = {(0, 0): 0}, [(0, 0)], []
        for a, b in todo:
            row = {}
            for symbol, (to_a, middle, w) in self.arcs[a].items():
                to_b, out, v = other.arcs[b][middle]
                if (to_a, to_b) not in numbers:
                    numbers[to_a, to_b] = len(numbers)
                    todo.append((to_a, to_b))
                row[symbol] = numbers[to_a, to_b], out, w + v
            arcs.append(row)
        return Transducer(arcs)

    def run(self, symbols: list[int]) -> list[tuple[int, float]]:
        """(symbol out, weight) of every symbol."""
        out, state = [], 0
        for s in symbols:
            state, symbol, weight = self.arcs[state][s]
            out.append((symbol, weight))
        return out


def _window(trigger: int, reach: int, rewrite: dict[int, int], symbols: range) -> Transducer:
    """After the trigger, symbols within the next ``reach`` places are rewritten."""
    arcs = []
    for left in range(reach + 1):
        row = {s: (max(0, left - 1), rewrite.get(s, s) if left else s, 0.0) for s in symbols}
        row[trigger] = (reach, trigger, 0.0)
        arcs.append(row)
    return Transducer(arcs)


def negation() -> Transducer:
    return _window(NOT, 3, {INSULT: DENIED, MENACE: DENIED_MENACE}, range(6))


def reported_speech() -> Transducer:
    """Once something is said, the rest of the clause is quoted."""
    quiet = {s: (0, s, 0.0) for s in range(8)}
    quoted = {s: (1, {INSULT: QUOTED, MENACE: QUOTED_MENACE}.get(s, s), 0.0) for s in range(8)}
    quiet[SAID] = quoted[SAID] = (1, SAID, 0.0)
    return Transducer([quiet, quoted])


def targets() -> Transducer:
    """An insult or threat within three words of somebody addressed is aimed; every match gets its weight.

    A target after the match adds what the match missed.  States 0-3: places since a target; 4-6: since an insult;
    7-9: since a threat.
    """
    matches, arcs = set(WEIGHTS), []
    for state in range(10):
        near = 1 <= state <= 3
        row = {}
        for s in range(10):
            out = {INSULT: AIMED, MENACE: AIMED_MENACE}.get(s, s) if near else s
            weight = WEIGHTS[out] if out in matches else 0.0
            if s == WHOM:
                late = INSULT if 4 <= state <= 6 else MENACE if state >= 7 else None
                if late is not None:
                    aimed = AIMED if late == INSULT else AIMED_MENACE
                    out, weight = aimed, WEIGHTS[aimed] - WEIGHTS[late]
                row[s] = (3, out, weight)
            elif out == INSULT:
                row[s] = (6, out, weight)
            elif out == MENACE:
                row[s] = (9, out, weight)
            else:
                row[s] = ({0: 0, 1: 0, 4: 0, 7: 0}.get(state, state - 1), out, weight)
        arcs.append(row)
    return Transducer(arcs)


def grammar() -> Transducer:
    return negation().compose(reported_speech()).compose(targets())


def word_features(text: str) -> set[str]:
    """Distinct words (as ``word$``) and word beginnings."""
    words = set(_WORD.findall(text.lower()))
    out = {w + "$" for w in words}
    for n in PREFIXES:
        out.update(w[:n] for w in words if len(w) >= n)
    return out


def least_documents(toxic: int) -> int:
    """Toxic documents that a feature must be in: one in a hundred, four at least."""
    return max(4, toxic // 100)


def learn_lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int, least: int) -> dict[str, float]:
    """(feature, toxic documents, clean documents) -> weights of the features that surely mark toxic documents.

    The weight is a lower bound of the log odds ratio; a feature needs a share of the toxic documents, so that words
    of one copied text don't enter.
    """
    out = {}
    for feature, a, b in counts:
        if a < least:
            continue
        ratio = math.log((a + 0.5) / (toxic - a + 0.5)) - math.log((b + 0.5) / (clean - b + 0.5))
        bound = ratio - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if bound > 1.5 and a >= 4 * b:
            out[feature] = round(bound, 6)
    return out


class Scorer:
    def __init__(self, lexicon: dict[str, float], slope: float = 1.0, level: float = 0.0):
        self.lexicon, self.slope, self.level = lexicon, slope, level
        self.machine = grammar()
        self.fixed = {w: s for words, s in ((THREAT, MENACE), (TARGET, WHOM), (NEGATION, NOT), (REPORTED, SAID))
                      for w in words}
        self.keys = {f.rstrip("$")[:4] for f in lexicon}
        self.cache: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        found = self.cache.get(word)
        if found is None:
            weight = max([self.lexicon.get(word + "$", 0.0), *(self.lexicon.get(word[:n], 0.0) for n in PREFIXES)]
                         ) if word[:4] in self.keys else 0.0
            found = (INSULT, weight) if weight > 0 else (self.fixed.get(word, OTHER), MENACE_WEIGHT)
            if len(self.cache) < 200_000:
                self.cache[word] = found
        return found

    def strength(self, text: str | None) -> float:
        """Sum of the strengths of the matched clauses."""
        if not text:
            return 0.0
        text = text.lower()
        words = set(_WORD.findall(text))
        if self.keys.isdisjoint({w[:4] for w in words}) and THREAT.isdisjoint(words):
            return 0.0
        total = 0.0
        for clause in _CLAUSE.split(text):
            symbols = [self.symbol(w) for w in _WORD.findall(clause)]
            if not any(s in (INSULT, MENACE) for s, _ in symbols):
                continue
            strength, held = 0.0, 0.0
            for (_, weight), (s, lexical) in zip(self.machine.run([s for s, _ in symbols]), symbols):
                if s in (INSULT, MENACE):
                    held = lexical
                strength += weight * held
            total += max(0.0, strength)
        return total

    def score(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.level + self.slope * math.log1p(strength)))))


def fit_curve(strengths: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, level) of a logistic curve over log(1 + strength), with a light ridge, by Newton steps."""
    x = np.column_stack([np.log1p(strengths), np.ones(len(y))])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + np.array([0.02, 1e-6]) * w * len(y) / 100
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([0.02, 1e-6]) * len(y) / 100
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _feature_counts(sample: DataFrame, lexicon: dict[str, float], least: int) -> tuple[list, int, int]:
    """(feature, toxic, clean documents) of the sample's documents in which the lexicon finds nothing, and their numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                seen = {0: Counter(), 1: Counter()}
                for text, toxic in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    if not lexicon or own.strength(text) == 0:
                        seen[int(toxic > 0)].update(word_features(text or "") | {ANY})
                names = list(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()),
                     pa.array([seen[0][x] for x in names], pa.int64())], names=["feature", "toxic", "clean"])

    counts = (sample.mapInArrow(count, "feature string, toxic long, clean long")
              .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
              .where((F.col("feature") == ANY) | (F.col("toxic") >= least) & (F.col("toxic") >= 4 * F.col("clean"))))
    rows = [tuple(r) for r in counts.collect()]
    toxic, clean = next(((a, b) for f, a, b in rows if f == ANY), (0, 0))
    return [r for r in rows if r[0] != ANY], toxic, clean


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    told = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (doc_crc(F.col("doc_id"), folds) != fold))
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # written first: with its size known it is broadcast, and the texts stay where they are
    picked = stage(told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "toxicity-labels")
    sample = docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "text", "toxic")
    sample = stage(sample, "toxicity-sample")
    sizes = sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()
    all_toxic = sum(r["count"] for r in sizes if r["toxic"])
    if not all_toxic or all_toxic == sum(r["count"] for r in sizes):
        return Scorer({}, 1.0, -3.0)
    # what the first words leave unexplained is learned from alone: a rarer language's words stand out there
    lexicon: dict[str, float] = {}
    least = least_documents(all_toxic)
    while True:  # every round explains documents that the rounds before left, so there is a last one
        counts, toxic, clean = _feature_counts(sample, lexicon, least)
        more = learn_lexicon(counts, toxic, clean, least) if toxic >= 3 else {}
        if not more:
            break
        lexicon, least = {**more, **lexicon}, 3

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([own.strength(t) for t in batch.column(1).to_pylist()], pa.float64()),
                 pa.array([int(x > 0) for x in batch.column(2).to_pylist()], pa.int64())], names=["id", "s", "y"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(strengths, f"id {kind}, s double, y long").orderBy("id", "s").toPandas()
    slope, level = fit_curve(rows["s"].to_numpy(float), rows["y"].to_numpy(float))
    return Scorer(lexicon, slope, level)


def scored(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = THRESHOLD,
           sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, strength."""
    model = train(docs, labels, folds, fold, sample_rows)
    parts = (model.lexicon, model.slope, model.level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*parts)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                strengths = [own.strength(t.as_py()) for t in part.column(1)]
                scores = [own.score(s) for s in strengths]
                held = [zlib.crc32(("" if i is None else str(i)).encode()) % folds == fold for i in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(held), pa.array(scores, pa.float64()),
                     pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(strengths, pa.float64())],
                    names=["doc_id", "held_out", "score", "predicted", "strength"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int, strength double")


__all__ = ["Scorer", "Transducer", "grammar", "scored", "train"]
