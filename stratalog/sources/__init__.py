"""Readers and writers: job manifests, raw logs, log archives and API payloads.

Whatever has ``runs(spark)`` is a source: it returns the runs with their logs, as ``COLUMNS`` tells.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a source's runs have: ``ord`` is their order, ``log`` is empty where there is none.
COLUMNS = (
    "ord bigint, run_id string, attempt int, repo string, workflow string, job string, branch string, commit string, actor string, "
    "event string, conclusion string, runner string, exit_code int, started_at timestamp, completed_at timestamp, log string"
)


class RunSource(Protocol):
    def runs(self, spark: SparkSession) -> DataFrame: ...


def as_runs(rows: DataFrame) -> DataFrame:
    """The columns of a source, cast to their types; those that are lacking are null, the log empty."""
    typed = []
    for column in COLUMNS.split(", "):
        name, kind = column.split(" ")
        value = F.col(name) if name in rows.columns else F.lit(None)
        typed.append((F.coalesce(value.cast(kind), F.lit("")) if name == "log" else value.cast(kind)).alias(name))
    return rows.select(*typed)


@dataclass(frozen=True)
class FileCorpus:
    """A directory with a manifest and logs."""

    root: str

    def runs(self, spark: SparkSession) -> DataFrame:
        from stratalog.sources import manifest

        return as_runs(manifest.read_corpus(spark, self.root))


@dataclass(frozen=True)
class RunTable:
    """Runs that are rows of Parquet files already, with their logs in a column or in files of their own (ord, log)."""

    path: str
    logs: str | None = None

    def runs(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(self.path)
        if self.logs:
            rows = rows.drop("log").join(spark.read.parquet(self.logs).select("ord", "log"), "ord", "left")
        return as_runs(rows)


@dataclass(frozen=True)
class Recordings:
    """Recorded API answers: JSON lines of (payload, jobs, archive), the archive a path below ``root`` or null."""

    path: str
    root: str

    def runs(self, spark: SparkSession) -> DataFrame:
        from stratalog.functions.runs import failed
        from stratalog.sources import api, manifest

        rows = spark.read.schema("payload string, jobs string, archive string").json(self.path)
        jobs = api.jobs(api.workflow_runs(rows)).withColumnRenamed("archive", "log_path").drop("payload")
        # the archives belong to failed runs only; an order that the rows themselves tell
        jobs = jobs.withColumn("log_path", F.when(failed(F.col("conclusion")), F.col("log_path"))).withColumn("log_job", F.col("job"))
        jobs = jobs.withColumn("ord", F.xxhash64("run_id", "attempt", "job"))
        paths = [r[0] for r in jobs.where("log_path IS NOT NULL").select("log_path").distinct().collect()]
        return as_runs(manifest.select_logs(jobs, manifest.read_logs(spark, self.root, paths)))
