"""Projecting recorded API payloads (workflow runs and their jobs) to runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.runs import outcome

WORKFLOW_RUN = (
    "id bigint, name string, path string, run_attempt int, event string, head_branch string, head_sha string, "
    "actor struct<login:string>, repository struct<full_name:string>"
)
JOB = (
    "run_attempt int, name string, conclusion string, started_at string, completed_at string, labels array<string>, "
    "runner_name string, steps array<struct<name:string,conclusion:string,number:int>>"
)


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def parse_timestamp(text: Column) -> Column:
    """ISO 8601; without an offset it is UTC (the session's zone)."""
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?$"
    bad = F.raise_error(F.concat(F.lit("not a timestamp: "), F.coalesce(text, F.lit("null")))).cast("timestamp")
    return F.when(text.rlike(shape), F.replace(text, F.lit("Z"), F.lit("+00:00")).try_cast("timestamp")).otherwise(bad)


def workflow_runs(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """run_id, attempt, repo, workflow, branch, commit, actor and event from JSON workflow runs."""
    p = payloads.withColumn("p", F.from_json(column, WORKFLOW_RUN))
    return p.withColumns(
        {
            "run_id": F.col("p.id").cast("string"),
            "attempt": F.coalesce("p.run_attempt", F.lit(1)),
            "repo": F.col("p.repository.full_name"),
            "workflow": F.coalesce(_filled(F.col("p.path")), F.col("p.name")),
            "branch": F.coalesce("p.head_branch", F.lit("")),
            "commit": F.col("p.head_sha"),
            "actor": F.col("p.actor.login"),
            "event": F.col("p.event"),
        }
    ).drop("p")


def exit_code(steps: Column) -> Column:
    """1 if any step failed, else null: the API does not tell the code."""
    return F.when(F.exists(steps, lambda s: s["conclusion"] == "failure"), F.lit(1))


def jobs(runs: DataFrame, column: str = "jobs") -> DataFrame:
    """One row per job of workflow runs with a JSON array of jobs."""
    each = runs.withColumn("j", F.explode(F.from_json(column, f"array<struct<{_struct(JOB)}>>"))).drop(column)
    return each.withColumns(
        {
            "job": F.col("j.name"),
            "attempt": F.coalesce("j.run_attempt", "attempt"),
            "conclusion": outcome(F.col("j.conclusion")),
            "started_at": parse_timestamp(F.col("j.started_at")),
            "completed_at": parse_timestamp(F.col("j.completed_at")),
            "runner": F.coalesce(_filled(F.col("j.runner_name")), _filled(F.get("j.labels", F.lit(0))), F.lit("unknown")),
            "exit_code": exit_code(F.col("j.steps")),
        }
    ).drop("j")


def _struct(fields: str) -> str:
    """``a int, b string`` as the inside of a struct type."""
    return ", ".join(f.strip().replace(" ", ":", 1) for f in _top_level(fields))


def _top_level(fields: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]
