"""Reading and writing a corpus directory: a versioned manifest of runs and their logs.

The manifest is one JSON document; it is validated on the driver, where an error can name its culprit. Logs
are read by Spark, only those of failed runs. Plain logs and zip archives may be mixed. A history too large
for one document enters as a table (``stratalog.sources.RunTable``).
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.logtext import universal_newlines
from stratalog.functions.runs import OUTCOMES
from stratalog.scratch import file_system

SCHEMA_VERSION = 1
REQUIRED = ("run_id", "repo", "workflow", "job", "branch", "commit", "actor", "conclusion", "started_at", "completed_at", "runner")
STAMP = re.compile(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?")

RUN = T.StructType(
    [
        T.StructField("ord", T.LongType(), False),
        T.StructField("run_id", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        *[T.StructField(n, T.StringType()) for n in ("repo", "workflow", "job", "branch", "commit", "actor", "event", "conclusion")],
        T.StructField("started_text", T.StringType()),
        T.StructField("completed_text", T.StringType()),
        T.StructField("runner", T.StringType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("log_path", T.StringType()),
        T.StructField("log_job", T.StringType()),
    ]
)


class IngestError(RuntimeError):
    """An input that cannot be read; the message names what is wrong with it."""


def outcome_of(value: str | None) -> str:
    if value is None:
        raise IngestError("the run is still in progress and has no conclusion")
    if value not in OUTCOMES:
        raise IngestError(f"unknown conclusion {value!r}")
    return OUTCOMES[value]


def _manifest_text(spark: SparkSession, root: str) -> str:
    path = f"{root.rstrip('/')}/runs.json"
    there, files = file_system(spark, path)
    if not files.exists(there):
        raise IngestError(f"{path} not found: is {root} a corpus directory?")
    return spark.read.text(path, wholetext=True).first()[0]


def entries(text: str) -> list[dict]:
    """The manifest's runs, each laid over the defaults; a key that is present wins even when it is null."""
    made = json.loads(text)
    if not isinstance(made, dict):
        raise IngestError("the manifest is not an object")
    if made.get("schema") != SCHEMA_VERSION:
        raise IngestError(f"unsupported corpus schema {made.get('schema')!r}")
    if not isinstance(made.get("runs"), list):
        raise IngestError("the manifest has no list of runs")
    defaults = made.get("defaults") or {}
    if not isinstance(defaults, dict):
        raise IngestError("the manifest's defaults are not an object")
    return [{**defaults, **entry} for entry in made["runs"]]


def _row(ord_: int, e: dict) -> tuple:
    missing = [k for k in REQUIRED if k not in e]
    if missing:
        raise IngestError(f"run {e.get('run_id', ord_)} lacks {', '.join(missing)}")
    run_id = str(e["run_id"])
    for key in ("started_at", "completed_at"):
        if not STAMP.fullmatch(str(e[key])):
            raise IngestError(f"{run_id} has an unparsable {key}: {e[key]!r}")
    conclusion = outcome_of(e["conclusion"])
    log = e.get("log") if conclusion != "success" else None
    code = e.get("exit_code")
    return (
        ord_, run_id, int(e.get("attempt", 1)), *(str(e[k]) for k in ("repo", "workflow", "job", "branch", "commit", "actor")),
        str(e.get("event", "push")), conclusion, str(e["started_at"]).replace("Z", "+00:00"), str(e["completed_at"]).replace("Z", "+00:00"),
        str(e["runner"]), None if code is None else int(code), log or None, str(e.get("log_job") or e["job"]),
    )


def _relative(root: str):
    return F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/").split("://")[-1].lstrip("/")) + "/", "")


def missing_files(spark: SparkSession, root: str, paths: Iterable[str]) -> list[str]:
    """Those of the paths below the root that are no files: one listing of the folder, whatever the number of paths."""
    wanted = sorted(set(paths))
    if not wanted:
        return []
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(_relative(root).alias("path"))
    asked = spark.createDataFrame([(p,) for p in wanted], "path string")
    return [r.path for r in asked.join(listed, "path", "left_anti").orderBy("path").limit(10).collect()]


def read_logs(spark: SparkSession, root: str, paths: Iterable[str]) -> DataFrame:
    """(path, place, job, log): plain logs have a null job, archives one row for each job in them, by its place."""
    root = root.rstrip("/")
    wanted = sorted(set(paths))
    zipped = [p for p in wanted if p.endswith(".zip")]
    plain = [p for p in wanted if not p.endswith(".zip")]
    out = spark.createDataFrame([], LOG)
    if plain:
        files = spark.read.format("binaryFile").load([f"{root}/{p}" for p in plain])
        text = universal_newlines(F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8"))
        out = out.unionByName(files.select(_relative(root).alias("path"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("job"), text.alias("log")))
    if zipped:
        files = spark.read.format("binaryFile").load([f"{root}/{p}" for p in zipped]).select(_relative(root).alias("path"), "content")
        out = out.unionByName(files.mapInPandas(_unzipped, LOG))
    return out


LOG = "path string, place int, job string, log string"
# Fixed value: a member of an archive that is a whole job's log.
MEMBER = re.compile(r"^(\d+)_(.+)\.txt$")


def read_archive(content: bytes) -> list[tuple[int, str, str]]:
    """(place, job, text) of the jobs in a log archive. A job that comes twice keeps its first place and its last text."""
    jobs: dict[str, list] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for place, info in enumerate(archive.infolist()):
            named = MEMBER.match(info.filename)
            if named:
                jobs.setdefault(named[2], [place, None])[1] = info
        rows = [(place, job, archive.read(info).decode("utf-8", "replace")) for job, (place, info) in jobs.items()]
    if not rows:
        raise IngestError("the log archive holds no top-level job logs")
    return rows


def _unzipped(batches):
    import pandas as pd

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):  # an archive at a time
            yield pd.DataFrame([(path, *row) for row in read_archive(bytes(content))], columns=["path", "place", "job", "log"])


def plain_name(job):
    """A job's name without what archives change in it."""
    return F.regexp_replace(F.lower(job), "[^a-z0-9]+", "")


def select_logs(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Adds ``log`` to runs with log_path and log_job: a plain log, the job's own member, or the first of the same plain name."""
    by_path = logs.withColumnRenamed("job", "member").withColumnRenamed("log", "found")
    tie = F.struct(F.when(F.col("member").isNull(), 0).when(F.col("member") == F.col("log_job"), 1).otherwise(2).alias("r"), "place")
    fits = F.col("member").isNull() | (F.col("member") == F.col("log_job")) | (plain_name(F.col("member")) == plain_name(F.col("log_job")))
    matched = (
        runs.where(F.col("log_path").isNotNull())
        .join(by_path, runs["log_path"] == by_path["path"])
        .groupBy("ord")
        .agg(
            F.min_by(F.when(fits, F.col("found")), F.when(fits, tie)).alias("log"),
            F.array_join(F.array_sort(F.collect_set("member")), ", ").alias("members"),
        )
    )
    joined = runs.join(matched, "ord", "left")
    lost = F.concat(F.lit("no log for job "), F.col("log_job"), F.lit(" in "), F.col("log_path"), F.lit("; it has: "), F.coalesce("members", F.lit("nothing")))
    log = F.when(F.col("log_path").isNull(), F.lit("")).when(F.col("log").isNull(), F.raise_error(lost).cast("string")).otherwise(F.col("log"))
    return joined.withColumn("log", log).drop("members", "log_path", "log_job")


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """The runs of a corpus directory with their logs; the log of a successful run is not read."""
    rows = [_row(i, e) for i, e in enumerate(entries(_manifest_text(spark, root)))]
    wanted = [r[-2] for r in rows if r[-2]]
    lost = missing_files(spark, root, wanted)
    if lost:
        whose = next(r[1] for r in rows if r[-2] == lost[0])
        raise IngestError(f"log file {lost[0]} of run {whose} is missing")
    runs = spark.createDataFrame(rows, RUN)
    stamped = runs.withColumn("started_at", F.col("started_text").cast("timestamp")).withColumn("completed_at", F.col("completed_text").cast("timestamp"))
    return select_logs(stamped.drop("started_text", "completed_text"), read_logs(spark, root, wanted))


def write_manifest(root: str, repo: str, runs: list[dict]) -> str:
    """Write ``runs`` as a manifest with the repository as a default; returns its path."""
    import os

    os.makedirs(root, exist_ok=True)
    path = os.path.join(root, "runs.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"schema": SCHEMA_VERSION, "defaults": {"repo": repo}, "runs": runs}, f, indent=2)
        f.write("\n")
    return path


def since(runs: DataFrame, days: int, now=None) -> DataFrame:
    """Runs, passing ones too, that started within the last days; ``now`` may be given."""
    moment = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return runs.where(F.col("started_at") >= moment - F.make_dt_interval(days=F.lit(days)))
