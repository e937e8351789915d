"""Verdicts from outcomes: what the same job did on the same commit.

Failures never meet their peers one by one. The runs of a commit key are aggregated once, to the two latest
passing runs of different identity and two failing identities, and each failure is joined with that one row:
a commit costs as many rows as it has runs. The peers themselves are listed only where they are asked for.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.runs import COMMIT_KEY, failed, label


def _keyed(left: str, right: str) -> Column:
    """Equal commit keys; a null part equals a null part."""
    return functools.reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in COMMIT_KEY])


def _identity() -> Column:
    return F.struct("run_id", "attempt")


def outcome_index(runs: DataFrame) -> DataFrame:
    """One row per commit key: ``best`` and ``second`` (latest passes of two identities), ``one`` and ``other`` (failing identities)."""
    who = F.struct("started_at", "attempt", "ord", "run_id")
    ok = ~failed(F.col("conclusion"))
    # the latest pass of each identity first, so that two rows of one run cannot hide a third
    latest = F.max(F.when(ok, who)).alias("p")
    fails = F.max(~ok).alias("fails")
    each = runs.groupBy(*COMMIT_KEY, "run_id", "attempt").agg(latest, fails)
    failing = F.when(F.col("fails"), _identity())
    ends = each.groupBy(*COMMIT_KEY).agg(F.max("p").alias("best"), F.min(failing).alias("one"), F.max(failing).alias("other"))
    rest = each.alias("x").join(ends.alias("y"), _keyed("x", "y"))
    again = F.col("x.run_id").eqNullSafe(F.col("y.best.run_id")) & F.col("x.attempt").eqNullSafe(F.col("y.best.attempt"))
    return rest.groupBy(*[F.col(f"x.{k}") for k in COMMIT_KEY]).agg(
        F.first("y.best").alias("best"), F.first("y.one").alias("one"), F.first("y.other").alias("other"), F.max(F.when(~again, F.col("x.p"))).alias("second")
    )


# The words of a verdict's reason.
PASSED, FAILED, ALONE = " passed unchanged", " failed again on {} without a change", " was never re-run, so nothing proves either way"


def classify(failures: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds verdict, reason and ``passing``, the label of the run that proves a flake, to failing runs.

    ``runs`` are all runs, passing ones included. Null parts of a commit key equal each other. See
    ``with_proof`` for the runs that prove a deterministic failure.
    """
    index = outcome_index(runs)
    own = F.struct(F.col("f.run_id"), F.col("f.attempt"))
    other = lambda r: ~(r["run_id"].eqNullSafe(F.col("f.run_id")) & r["attempt"].eqNullSafe(F.col("f.attempt")))
    best, second = F.col("i.best"), F.col("i.second")
    passing = F.when(best.isNotNull() & other(best), best).when(best.isNotNull() & second.isNotNull(), second)
    same = F.coalesce(F.col("i.one") != own, F.lit(False)) | F.coalesce(F.col("i.other") != own, F.lit(False))
    joined = failures.alias("f").join(index.alias("i"), _keyed("f", "i"), "left").select("f.*", passing.alias("pass"), same.alias("same"))
    short = F.substring("commit", 1, 8)
    how = F.when(F.col("pass.run_id") == F.col("run_id"), "a retry of ").otherwise("another run of ")
    flaky = F.col("pass").isNotNull()
    before, after = FAILED.split("{}")
    reason = (
        F.when(flaky, F.concat(how, "job", F.lit(" on "), short, F.lit(PASSED)))
        .when(F.col("same"), F.concat("job", F.lit(before), short, F.lit(after)))
        .otherwise(F.concat(short, F.lit(ALONE)))
    )
    verdict = F.when(flaky, "flaky").when(F.col("same"), "deterministic").otherwise("unproven")
    shown = F.when(flaky, label(F.col("pass.run_id"), F.col("pass.attempt")))
    return joined.withColumns({"verdict": verdict, "reason": reason, "passing": shown}).drop("pass", "same")


def peers(failures: DataFrame, runs: DataFrame) -> DataFrame:
    """(ord, peer, passed): every run of another identity on the commit key of a failure, as pairs.

    The pairs of a commit grow with the square of its runs; ``classify`` does without them.
    """
    f, r = failures.alias("f"), runs.alias("r")
    same = F.col("f.run_id").eqNullSafe(F.col("r.run_id")) & F.col("f.attempt").eqNullSafe(F.col("r.attempt"))
    pairs = f.join(r, _keyed("f", "r") & ~same)
    return pairs.select("f.ord", label(F.col("r.run_id"), F.col("r.attempt")).alias("peer"), (~failed(F.col("r.conclusion"))).alias("passed"))


def with_proof(judged: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds ``proof``: the passing run of a flake, or all other failing runs of a deterministic failure, in order."""
    bad = runs.where(failed(F.col("conclusion")))
    listed = bad.groupBy(*COMMIT_KEY).agg(F.array_sort(F.collect_list(label(F.col("run_id"), F.col("attempt")))).alias("all"))
    joined = judged.alias("j").join(listed.alias("l"), _keyed("j", "l") & (F.col("j.verdict") == "deterministic"), "left")
    others = F.filter("l.all", lambda x: x != label(F.col("j.run_id"), F.col("j.attempt")))
    none = F.array().cast("array<string>")
    proof = F.when(F.col("j.verdict") == "flaky", F.array("j.passing")).when(F.col("j.verdict") == "deterministic", others).otherwise(none)
    return joined.select("j.*", proof.alias("proof"))


def verdict_of(flaky, deterministic):
    """A cluster's verdict from the numbers of its members' verdicts."""
    return F.when((flaky > 0) & (flaky >= deterministic), "flaky").when(deterministic > 0, "deterministic").otherwise("unproven")
