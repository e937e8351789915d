"""Toxicity by maximum-scoring segments over token log-odds.

Training counts in how many toxic and how many clean labelled texts each feature occurs; a feature is a
word or the first four or five letters of a word. Its score is the log-odds ratio under an informative
Dirichlet prior, pulled towards zero by a multiple of its standard deviation. A word is scored by itself,
or by its prefixes where they tell more; all other words drift slightly below zero.

A text is then a sequence of scores. One linear scan finds all maximal scoring segments (Ruzzo and
Tompa). Segment scores of random sequences follow an extreme-value law (Karlin and Altschul): with the
decay rate ``lam`` of the background scores, a segment of score S in a text of n words has about
K*n*exp(-lam*S) equals by chance. Segments below one chance in twenty are the significant passages; their
normalised scores lam*S - ln(K*n) are summed and put on the scale of a probability by logistic regression
on labelled texts, each scored by a model that was counted without it.

Only labels of training rows are read; language, source and id are no inputs.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import bounded_batches, cut, table

WORD = re.compile(r"\w+")
#: At most about so many labelled texts train the model; beyond, a hash of the id picks them.
MAX_TRAINING = 40_000
#: Strength of the Dirichlet prior as a share of the training counts, and its floor for one feature.
PRIOR_SHARE, PRIOR_FLOOR = 0.01, 0.5
#: Standard deviations by which a log-odds ratio is pulled towards zero.
CAUTION = 1.28
#: Score of a word without a known feature; least score of any word.
DRIFT, LEAST = -0.25, -1.0
K, SIGNIFICANT = 0.1, 0.05
PREFIXES = (4, 5)


def features(text: str | None) -> set[str]:
    """The words of a text and their prefixes, which carry a ^ before them."""
    words = set(WORD.findall((text or "").lower()))
    return words | {"^" + w[:n] for w in words for n in PREFIXES if len(w) > n}


@dataclass
class Model:
    scores: dict[str, float]
    lam: float = 1.0
    bias: float = 0.0
    slope: float = 1.0

    def __post_init__(self) -> None:
        self._memo: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_memo"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _memo={})

    def word_score(self, word: str) -> float:
        found = self._memo.get(word)
        if found is None:
            known = [s for f in (word, *("^" + word[:n] for n in PREFIXES if len(word) > n)) if (s := self.scores.get(f)) is not None]
            found = max(known) if known else DRIFT
            if found < 0:
                found = max(LEAST, self.scores.get(word, DRIFT))
            if len(self._memo) > 200_000:
                self._memo.clear()
            self._memo[word] = found
        return found

    def evidence(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Summed normalised score of the significant passages, and (first word, past, score, chance) of each."""
        words = WORD.findall((text or "").lower())
        score = self.word_score
        scores = [score(w) for w in words]
        found, total = [], 0.0
        for first, past, s in maximal_segments(scores):
            normal = self.lam * s - math.log(K * max(len(words), 1 / K))
            chance = -math.expm1(-math.exp(-min(normal, 700.0))) if normal > -20 else 1.0
            if chance <= SIGNIFICANT:
                found.append((first, past, s, chance))
                total += normal
        return total, found

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.bias + self.slope * scaled(evidence)))))


def scaled(evidence: float) -> float:
    return math.log1p(max(0.0, evidence))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past, score) in one pass; scores of zero or less start none.

    Candidates are kept with the running sum before and after them. A new candidate looks back for the
    nearest one with a smaller sum before it and takes in everything since, unless that one ends higher.
    """
    running, kept = 0.0, []  # kept: (first, past, sum before, sum after, index of the nearest smaller sum before)
    for i, x in enumerate(scores):
        before, running = running, running + x
        if x <= 0:
            continue
        new = (i, i + 1, before, running)
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                kept.append((*new, j))
                break
            new = (kept[j][0], new[1], kept[j][2], new[3])
            del kept[j:]
    return [(first, past, after - before) for first, past, before, after, _ in kept]


def cautious_score(y0: Column, y1: Column, texts: tuple[int, int], needed: float) -> Column:
    """Cautious log-odds of a feature that y0 clean and y1 toxic texts hold, of so many texts each; zero if it tells nothing.

    A feature counts as toxic only if so many toxic texts among those that hold it are less likely by chance
    than exp(-needed) (Chernoff's bound). With the logarithm of the number of features looked at, less than
    one is expected by chance: rare words that a few toxic texts happen to share would else add up in long
    clean texts.
    """
    n0, n1 = float(max(texts[0], 1)), float(max(texts[1], 1))
    p = n1 / (n0 + n1)
    prior = F.greatest(F.lit(PRIOR_FLOOR), PRIOR_SHARE * (y0 + y1))
    a0, a1 = F.greatest(prior * (1 - p), F.lit(PRIOR_FLOOR)), F.greatest(prior * p, F.lit(PRIOR_FLOOR * p))
    odds = F.log((y1 + a1) / (n1 + a1 + a0 - y1)) - F.log((y0 + a0) / (n0 + a1 + a0 - y0))
    sd = F.sqrt(1 / (y1 + a1) + 1 / (y0 + a0))
    part = lambda y, share: F.when(y > 0, y * F.log(y / (y0 + y1) / share)).otherwise(0.0)
    surprise = F.when(y1 > 0, part(y1, p) + part(y0, 1 - p)).otherwise(0.0)
    toxic = (odds > 0) & (odds > CAUTION * sd) & (surprise >= needed)
    return F.when(toxic, odds - CAUTION * sd).when((odds <= 0) & (odds + CAUTION * sd < 0), odds + CAUTION * sd).otherwise(0.0)


def decay_rate(frequency: dict[float, float]) -> float:
    """The positive root of E[exp(lam * score)] = 1 over the background scores."""
    xs = np.array(list(frequency), float)
    ps = np.array(list(frequency.values()), float)
    ps = ps / max(ps.sum(), 1e-12)
    if not len(xs) or xs.max() <= 0 or (xs * ps).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (ps * np.exp(np.minimum(700, high * xs))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (ps * np.exp(np.minimum(700, mid * xs))).sum() < 1 else (low, mid)
    return min(low, 4.0)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope of a logistic regression with a slight ridge, by Newton's method."""
    design = np.c_[np.ones(len(x)), x]
    beta = np.array([-2.0, 1.0])
    ridge = np.diag([1e-3, 1e-2])
    centre = np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge @ (beta - centre)
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.05))


def is_held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(text, y, half) of at most about ``limit`` labelled rows that are not held out, one for each text and label."""
    known = labels.select(F.col("doc_id").cast("long").alias("lid"), F.col("toxic").cast("int").alias("y")).where(
        "lid IS NOT NULL AND y IN (0, 1)"
    )
    known = known.where(~is_held_out("lid")).groupBy("lid").agg(F.max("y").alias("y"))
    n = known.count()
    if n > limit:
        known = known.where(F.pmod(F.xxhash64("lid"), F.lit(1_000_000)) < int(1_000_000 * limit / n))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = picked.join(known, picked["doc_id"] == known["lid"]).where("text IS NOT NULL")
    rows = rows.groupBy(F.xxhash64("text").alias("h"), "y").agg(F.min("text").alias("text"))
    return rows.select("text", "y", F.pmod("h", F.lit(2)).cast("int").alias("half"))


def _count(batches):
    """Feature counts of a task's rows; sums are sent on whenever the table of counts gets large."""
    counts: Counter = Counter()

    def flush():
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.int32()),
                pa.array([counts[k] for k in keys], pa.int64()),
            ],
            names=["f", "half", "y", "n"],
        )
        counts.clear()

    for batch in batches:
        for text, y, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts.update((f, half, y) for f in features(text))
            if len(counts) > 300_000:
                yield from flush()
    yield from flush()


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING) -> Model:
    """The model from labelled rows. Without labels of both kinds every text scores alike, below one half.

    It holds every feature with a score; the bound of the training texts bounds their number.
    """
    bounded_batches(docs.sparkSession)
    rows = cut(training_rows(docs, labels, limit))
    texts = {(r.half, r.y): r["count"] for r in rows.groupBy("half", "y").count().collect()}
    of = lambda halves, y: sum(texts.get((h, y), 0) for h in halves)
    if not of((0, 1), 0) or not of((0, 1), 1):
        return Model({}, 1.0, -3.0, 0.0)
    counted = rows.mapInArrow(_count, "f string, half int, y int, n long")
    summed = counted.groupBy("f").agg(
        *[F.sum(F.when((F.col("half") == h) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)]
    )

    def scored(halves: tuple[int, ...], needed: float) -> Column:
        held = lambda y: functools.reduce(lambda a, b: a + b, [F.col(f"n{h}{y}") for h in halves])
        return cautious_score(held(0), held(1), (of(halves, 0), of(halves, 1)), needed)

    parts = {"whole": (0, 1), "first": (0,), "second": (1,)}
    may_count = functools.reduce(lambda a, b: a | b, [scored(halves, 0.0) != 0 for halves in parts.values()])
    # looked at are the features that more than one toxic text holds
    several = F.col("n01") + F.col("n11") >= 2
    summed = cut(summed.where(several | may_count))
    needed = math.log(max(summed.where(several).count(), 1))
    kept = summed.select("f", *[scored(halves, needed).alias(name) for name, halves in parts.items()])
    found = kept.where("whole <> 0 OR first <> 0 OR second <> 0").collect()

    def model(name: str) -> Model:
        return Model({r.f: r[name] for r in found if r[name]})

    halves = rows.sparkSession.sparkContext.broadcast([model("second"), model("first")])
    whole = rows.sparkSession.sparkContext.broadcast(model("whole"))

    def background(batches):
        """Word scores of clean texts: how often each (rounded) occurs when the words were not counted."""
        tally: Counter = Counter()
        for batch in batches:
            for text, y, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if y == 0:
                    score = halves.value[half].word_score
                    tally.update(round(score(w), 1) for w in WORD.findall((text or "").lower()))
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.float64()), pa.array(list(tally.values()), pa.int64())], names=["s", "n"])

    spectrum = rows.mapInArrow(background, "s double, n long").groupBy("s").agg(F.sum("n").alias("n"))
    lam = decay_rate({r.s: float(r.n) for r in spectrum.collect()})

    def held(batches):
        for batch in batches:
            xs, ys = [], batch.column(1)
            for text, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                m = halves.value[half]
                m.lam = lam
                xs.append(scaled(m.evidence(text)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.float64()), ys], names=["x", "y"])

    pairs = rows.mapInArrow(held, "x double, y int").groupBy(F.round("x", 2).alias("x"), "y").agg(F.count(F.lit(1)).alias("n")).collect()
    x = np.repeat([r.x for r in pairs], [r.n for r in pairs])
    y = np.repeat([r.y for r in pairs], [r.n for r in pairs]).astype(float)
    bias, slope = fit_logistic(x, y)
    out = Model(whole.value.scores, lam, bias, slope)
    halves.destroy()
    whole.destroy()
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) of every row of ``docs``; passages are [start, end) code points of the text.

    A null text counts as empty and scores as a text without evidence. Rows are treated one by one, so
    repeated rows and ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, passages array<struct<start:long,end:long,score:double,chance:double>>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))

    def run(batches):
        m = handle.value
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                total, found = m.evidence(text)
                scores.append(m.probability(total))
                passages.append(located(text, found) if found else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "passages"]
            )

    bounded_batches(docs.sparkSession)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, schema)


def located(text: str, found: list[tuple[int, int, float, float]]) -> list[dict]:
    # lower-casing may change a text's length: words are found again in the text itself
    at = [m.span() for m in WORD.finditer(text)]
    last = len(at) - 1
    return [{"start": at[min(a, last)][0], "end": at[min(b - 1, last)][1], "score": s, "chance": c} for a, b, s, c in found] if at else []


def clean_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, that score below ``threshold``.

    A null text scores as an empty one; repeated rows are treated one by one; an empty table stays empty.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        m = handle.value
        for batch in batches:
            keep = [m.probability(m.evidence(t)[0]) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(is_held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
