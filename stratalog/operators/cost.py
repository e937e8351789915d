"""What clusters cost, who they stop, and how they rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.functions.runs import NOT_OUR_CODE, duration_micros, failed, runner_multiplier, share
from stratalog.operators.evidence import verdict_of


def priced(runs: DataFrame) -> DataFrame:
    """Adds wall_micros and billable_micros, exact integers."""
    wall = duration_micros(F.col("started_at"), F.col("completed_at"))
    return runs.withColumn("wall_micros", wall).withColumn("billable_micros", F.col("wall_micros") * runner_multiplier(F.col("runner")))


def seconds(micros: Column) -> Column:
    return micros.cast("double") / 1e6


def cost_by(failures: DataFrame, *keys: str) -> DataFrame:
    """Occurrences, machine time, people and branches of priced failures, for each value of the keys."""
    return failures.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.sum("wall_micros").alias("wall_micros"),
        F.sum("billable_micros").alias("billable_micros"),
        F.countDistinct("actor").alias("people_blocked"),
        F.countDistinct("branch").alias("branches_blocked"),
    )


def clusters(members: DataFrame) -> DataFrame:
    """One row per cluster from its judged, priced members."""
    key = F.struct("started_at", -F.col("first_ord"), -F.col("ord"))  # newest; the first member among equals
    last = F.struct("started_at", "first_ord", "ord")
    count = lambda v: F.count_if(F.col("verdict") == v)
    newest = F.struct("span.category", "span.rule", "span.summary", F.col("span").alias("example"), "run_id", "attempt")
    base = members.groupBy("cluster_id").agg(
        F.max_by(newest, key).alias("newest"),
        F.max_by(F.struct("run_id", "attempt"), last).alias("last_member"),
        count("flaky").alias("proven_flaky"),
        count("deterministic").alias("reproduced"),
        count("unproven").alias("never_rerun"),
        F.min("started_at").alias("first_seen"),
        F.max("started_at").alias("last_seen"),
        F.array_sort(F.collect_set("job")).alias("jobs"),
    )
    priced_clusters = cost_by(members, "cluster_id")
    return base.join(priced_clusters, "cluster_id").select(
        "cluster_id",
        F.col("newest.rule").alias("rule"),
        F.col("newest.category").alias("category"),
        F.col("newest.summary").alias("summary"),
        F.col("newest.example").alias("example"),
        F.col("newest.run_id").alias("example_run_id"),
        F.col("newest.attempt").alias("example_attempt"),
        "last_member",
        verdict_of(F.col("proven_flaky"), F.col("reproduced")).alias("verdict"),
        "occurrences",
        "wall_micros",
        "billable_micros",
        (seconds(F.col("wall_micros")) / F.col("occurrences")).alias("mean_wall_seconds"),
        "people_blocked",
        "branches_blocked",
        "proven_flaky",
        "reproduced",
        "never_rerun",
        "jobs",
        "first_seen",
        "last_seen",
    )


ORDERS = {
    "cost": [F.desc, "billable_micros"],
    "occurrences": [F.desc, "occurrences"],
    "people": [F.desc, "people_blocked", "billable_micros"],
}


def ordering(by: str, key: str = "cluster_id") -> list[Column]:
    direction, *columns = ORDERS[by]
    return [*[direction(c) for c in columns], F.asc(key)]


def ranked(costs: DataFrame, by: str, key: str = "cluster_id", top: int | None = None) -> DataFrame:
    """Adds ``rank`` from 1; with ``top`` only the first rows, found without sorting all of them in one task."""
    order = ordering(by, key)
    rows = costs.orderBy(*order).limit(top) if top else costs
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def totals(runs: DataFrame, clusters_found: DataFrame | None = None) -> DataFrame:
    """One row over all priced runs, failed or not."""
    bad = failed(F.col("conclusion"))
    out = runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(bad).alias("failed_runs"),
        F.count_if(~bad).alias("succeeded_runs"),
        F.coalesce(F.sum(F.when(bad, F.col("wall_micros"))), F.lit(0)).cast("long").alias("wall_micros"),
        F.coalesce(F.sum(F.when(bad, F.col("billable_micros"))), F.lit(0)).cast("long").alias("billable_micros"),
        F.min("started_at").alias("window_start"),
        F.max("started_at").alias("window_end"),
    )
    if clusters_found is None:
        return out
    return out.crossJoin(clusters_found.agg(F.count(F.lit(1)).alias("clusters"), infrastructure_share().alias("not_our_code_share")))


def infrastructure_share() -> Column:
    """Aggregate: the share of billable time in categories that are not the code's."""
    mine = F.sum(F.when(F.col("category").isin(*NOT_OUR_CODE), F.col("billable_micros")).otherwise(0))
    return share(mine, F.sum("billable_micros"))
