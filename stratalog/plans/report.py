"""The end-to-end plan: runs in; clusters, their members and totals out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.runs import failed
from stratalog.operators import clustering, cost, evidence, extraction
from stratalog.scratch import cut


class Report(NamedTuple):
    clusters: DataFrame
    members: DataFrame
    totals: DataFrame
    runs: DataFrame


def failures(runs: DataFrame) -> DataFrame:
    """Failed runs with span, fingerprint and price; only they have their logs looked at."""
    bad = cost.priced(runs.where(failed(F.col("conclusion"))))
    return extraction.fingerprinted(extraction.extract(bad)).drop("log")


def analyse(runs: DataFrame, threshold: float = clustering.THRESHOLD) -> Report:
    """Clusters of failures with cost and verdict. ``runs`` hold passing runs too: they are the evidence."""
    all_runs = cut(runs.drop("log"))
    judged = cut(evidence.classify(clustering.clustered(failures(runs), threshold), all_runs))
    found = cost.clusters(judged)
    return Report(found, judged, cost.totals(cost.priced(all_runs), found), all_runs)


def proven(report: Report) -> DataFrame:
    """The members of all clusters with the runs that prove their verdicts."""
    return evidence.with_proof(report.members, report.runs)


def explain(runs: DataFrame, run_id: str, attempt: int | None = None) -> DataFrame:
    """Span and fingerprint of the attempts of one run, whatever its outcome."""
    mine = runs.where(F.col("run_id") == run_id)
    if attempt is not None:
        mine = mine.where(F.col("attempt") == attempt)
    return extraction.fingerprinted(extraction.extract(mine))
