"""Grouping failures: equal fingerprints first, then similar ones that agree in what must agree.

Fingerprints of one category and one set of discriminators form a bucket. The pairs of a bucket, smaller
digest first, are a join of the fingerprints with themselves; pairs whose lengths already tell that they are
too different fall away in the join, the rest are compared in batches, and groups are the components of the
similar pairs. Buckets are compared up to ``MAX_BUCKET`` fingerprints, as published;
``max_bucket=None`` compares all of them.
"""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stratalog.scratch import cut, unconstrained

# The threshold and the size beyond which a bucket is left as it is.
THRESHOLD, MAX_BUCKET = 0.88, 60
BUCKET = ["category", "discriminators"]


def ratio(left: str, right: str) -> float:
    """Ratcliff-Obershelp similarity: twice the matching characters over all characters."""
    return difflib.SequenceMatcher(a=left, b=right, autojunk=False).ratio()


def _compared(threshold: float):
    """A column function of two texts: their similarity, or null where their letters alone rule it out."""

    @F.pandas_udf(T.DoubleType())
    def compared(left, right):
        import pandas as pd

        def one(a: str, b: str) -> float | None:
            pair = difflib.SequenceMatcher(a=a, b=b, autojunk=False)
            return pair.ratio() if pair.quick_ratio() >= threshold else None

        return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")

    return compared


def fingerprints(failures: DataFrame) -> DataFrame:
    """One row per digest: its text, discriminators, category of the first failure seen, and that failure's place."""
    return failures.groupBy("digest").agg(
        F.min("normalised").alias("normalised"),
        F.min("discriminators").alias("discriminators"),
        F.min_by("span.category", "ord").alias("category"),
        F.min("ord").alias("first_ord"),
    )


def similar_pairs(prints: DataFrame, threshold: float = THRESHOLD, max_bucket: int | None = MAX_BUCKET) -> DataFrame:
    """(a, b, similarity): pairs of digests of a bucket, a < b, that are similar enough."""
    whole = Window.partitionBy(*BUCKET)
    rows = prints if max_bucket is None else prints.withColumn("of", F.count(F.lit(1)).over(whole)).where(F.col("of") <= max_bucket)
    # null-safe, as one value: the bucket is then a plain key of the join
    bucket = F.sha2(F.to_json(F.struct(*BUCKET)), 256)
    slim = cut(rows.select(bucket.alias("bucket"), "digest", "normalised", F.char_length("normalised").alias("n")))
    l, r = slim.alias("l"), slim.alias("r")
    n = F.col("l.n") + F.col("r.n")
    near = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.digest") < F.col("r.digest"))
    pairs = l.join(r, near & (2 * F.least("l.n", "r.n") >= threshold * n))
    pairs = pairs.select(F.col("l.digest").alias("a"), F.col("r.digest").alias("b"), _compared(threshold)("l.normalised", "r.normalised").alias("similarity"))
    return pairs.where(F.col("similarity") >= threshold)


def smallest_reachable(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(digest, cluster_id): the smallest digest that the links (a, b) reach from each digest of ``nodes``.

    Every round each digest takes the smallest label among itself and its neighbours, and then the label of
    that label, so a chain is halved in every round.
    """
    with unconstrained(nodes.sparkSession):
        both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        label = cut(nodes.select("digest", F.col("digest").alias("cluster_id")))
        while not both.isEmpty():
            offered = both.join(label, F.col("b") == F.col("digest")).groupBy("a").agg(F.min("cluster_id").alias("near"))
            lower = label.join(offered, F.col("digest") == F.col("a"), "left").select("digest", F.least("cluster_id", "near").alias("low"), F.col("cluster_id").alias("was"))
            of = label.select(F.col("digest").alias("d"), F.col("cluster_id").alias("next"))
            found = cut(lower.join(of, F.col("low") == F.col("d")).select("digest", F.least("low", "next").alias("cluster_id"), "was"))
            label = found.select("digest", "cluster_id")
            if found.where("cluster_id <> was").isEmpty():
                break
    return label


def merge_similar(prints: DataFrame, threshold: float = THRESHOLD, max_bucket: int | None = MAX_BUCKET) -> DataFrame:
    """(digest, cluster_id): the smallest digest that links of similarity reach inside a bucket."""
    return smallest_reachable(prints, similar_pairs(prints, threshold, max_bucket))


#: Digests with more failures than this are named by broadcast, so that none is gathered in one task.
OFTEN, MOST_OFTEN = 1000, 10_000


def clustered(failures: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``cluster_id`` and ``first_ord`` (place of the digest's first failure) to fingerprinted failures."""
    failures = cut(failures)  # extraction and hash are costly and needed twice
    prints = cut(fingerprints(failures))
    ids = merge_similar(prints, threshold).join(prints.select("digest", "first_ord"), "digest")
    counts = failures.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"))
    bound = max(OFTEN, failures.count() // MOST_OFTEN)  # so many digests at most are above it
    named = cut(ids.join(counts, "digest"))
    often, seldom = (named.where(c).drop("rows") for c in (F.col("rows") > bound, F.col("rows") <= bound))
    hot = failures.join(F.broadcast(often), "digest")
    rest = failures.join(F.broadcast(often.select("digest")), "digest", "left_anti").join(seldom, "digest")
    return hot.unionByName(rest)
