import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import toxicity

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
LABEL = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def brute_segments(xs):
    """All maximal segments by their definition: repeatedly the best segment, then left and right of it."""
    def best(lo, hi):
        found = None
        for i in range(lo, hi):
            s = 0
            for j in range(i, hi):
                s += xs[j]
                key = (s, -(j - i), -i)
                if s > 0 and (found is None or key > found[0]):
                    found = (key, i, j + 1)
        if found is None:
            return []
        _, i, j = found
        return [*best(lo, i), (i, j, sum(xs[i:j])), *best(j, hi)]

    return best(0, len(xs))


def test_all_maximal_segments():
    rng = random.Random(8)
    for _ in range(300):
        xs = [rng.choice([-5, -3, -2, -1, 1, 2, 3, 4, 7]) + rng.random() for _ in range(rng.randint(0, 14))]
        got = toxicity.maximal_segments(xs)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(xs)]
        assert all(abs(s - sum(xs[a:b])) < 1e-9 for a, b, s in got)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    bad = ["zorgle", "quibnax", "snarfy", "vexword"]
    docs, labels = [], []
    for i in range(700):
        toxic = i % 6 == 0
        text = [rng.choice(words) for _ in range(rng.choice([4, 30, 120]))]
        if toxic:
            for _ in range(3):
                text.insert(rng.randint(0, len(text)), rng.choice(bad))
        docs.append((i, " ".join(text), "clash"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_passages(spark, corpus):
    docs, labels = corpus
    odd = [(None, "zorgle snarfy", None), (9000, None, None), (9001, "", None), (9002, "ok " * 150_000, None), (3, docs[3][1], None)]
    frame, known = spark.createDataFrame(docs + odd, DOC), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (77777, 0, 1)], LABEL)
    model = toxicity.train(frame, known)
    got = toxicity.score(frame, model).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.doc_id in truth and toxicity.held_out(r.doc_id)]
    right = sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held)
    assert len(held) > 80 and right >= 0.97 * len(held)
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].score > 0.5 and max(by_id[i].score for i in (9000, 9001, 9002)) < 0.5
    for r in got:
        if r.doc_id in truth and truth[r.doc_id] and r.passages:
            assert all(docs[r.doc_id][1][p.start : p.end].split()[0] for p in r.passages)
    kept = toxicity.clean_documents(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(r.score < 0.5 for r in got)


def test_held_out_labels_are_not_read(spark, corpus):
    docs, labels = corpus
    frame = spark.createDataFrame(docs, DOC)
    flipped = [(i, q, 1 - t if toxicity.held_out(i) else t) for i, q, t in labels]
    a, b = (toxicity.train(frame, spark.createDataFrame(x, LABEL)) for x in (labels, flipped))
    assert a.scores == b.scores and (a.lam, a.bias, a.slope) == (b.lam, b.bias, b.slope)


def test_without_labels_or_rows(spark):
    frame = spark.createDataFrame([(1, "a b", None)], DOC)
    for known in ([], [(1, 1, 1)]):
        model = toxicity.train(frame, spark.createDataFrame(known, LABEL))
        assert [r.score < 0.5 for r in toxicity.score(frame, model).collect()] == [True]
    assert toxicity.score(frame.limit(0), model).count() == 0


def slow_score(y0, y1, n0, n1, needed):
    """The score of a feature by plain arithmetic."""
    p = n1 / (n0 + n1)
    prior = max(toxicity.PRIOR_FLOOR, toxicity.PRIOR_SHARE * (y0 + y1))
    a0, a1 = max(prior * (1 - p), toxicity.PRIOR_FLOOR), max(prior * p, toxicity.PRIOR_FLOOR * p)
    odds = math.log((y1 + a1) / (n1 + a1 + a0 - y1)) - math.log((y0 + a0) / (n0 + a1 + a0 - y0))
    pull = toxicity.CAUTION * math.sqrt(1 / (y1 + a1) + 1 / (y0 + a0))
    if odds <= 0:
        return min(0.0, odds + pull)
    surprise = sum(y * math.log(y / (y0 + y1) / q) for y, q in ((y1, p), (y0, 1 - p)) if y) if y1 else 0.0
    return odds - pull if odds > pull and surprise >= needed else 0.0


def test_scores_of_features_and_texts_against_loops(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0, 1, 3, 40, 300, 900]), rng.choice([0, 1, 2, 9, 80])) for _ in range(200)]
    frame = spark.createDataFrame(rows, "y0 long, y1 long")
    for needed in (0.0, 6.0):
        got = frame.select("y0", "y1", toxicity.cautious_score(F.col("y0"), F.col("y1"), (1000, 100), needed).alias("s")).collect()
        assert all(abs(r.s - slow_score(r.y0, r.y1, 1000, 100, needed)) < 1e-9 for r in got) and len({r.s for r in got}) > 5
    model = toxicity.Model({"bad": 2.5, "^badl": 1.5, "fine": -0.5, "awful": 3.0}, lam=0.8, bias=-1.0, slope=2.0)
    words = {"bad": 2.5, "badly": 1.5, "fine": -0.5, "awful": 3.0, "other": toxicity.DRIFT}
    for _ in range(100):
        text = [rng.choice(list(words)) for _ in range(rng.randint(1, 12))]
        total = 0.0
        for _, _, s in brute_segments([words[w] for w in text]):
            normal = model.lam * s - math.log(toxicity.K * max(len(text), 1 / toxicity.K))
            if 1 - math.exp(-math.exp(-normal)) <= toxicity.SIGNIFICANT:
                total += normal
        assert abs(model.evidence(" ".join(text))[0] - total) < 1e-9
        assert abs(model.probability(total) - 1 / (1 + math.exp(1.0 - 2.0 * math.log(1 + total)))) < 1e-9
