"""The shipped tables seen as runs and logs, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAMPED = "2026-01-01T00:00:00.000Z "
#: (failure line, rule, category, weight, lines before, last line: -1 the anchor, else lines after, pattern of the summary)
PLANTED = (
    ("Out of memory: Killed process 4121 (worker)", "oom-kill", "resource", 100, 6, 5, "Out of memory|OOMKilled|Killed|signal: killed|137"),
    ("write error: No space left on device", "disk-full", "resource", 92, 4, 4, "$^x"),
    ("error: Could not resolve host: mirror.example.org", "registry-unavailable", "infrastructure", 90, 4, 12, "5[0-9][0-9]|429|TLS handshake|resolve host|EAI_AGAIN"),
    ("job has exceeded the maximum execution time of 45 minutes", "runner-timeout", "timeout", 86, 8, 4, "$^x"),
    ("ERROR: failed to solve: exit code: 2", "docker-build", "build", 70, 30, -1, "^ERROR: failed to solve|returned a non-zero code"),
    ("panic: send on closed channel", "go-test-panic", "test", 68, 3, 40, "^panic: "),
    ("[ERROR] Tests run: 12, Failures: 1, Errors: 0, Skipped: 0", "maven-test", "test", 66, 1, 20, "^\\[ERROR\\][ \\t]+[^ ]+\\.[^ ]+ -- "),
    ("npm ERR! code E404", "npm-error", "dependency", 64, 0, 25, "$^x"),
    ("FAILURE: Build failed with an exception.", "gradle-failure", "build", 64, 0, 30, "^> |^Execution failed for task "),
    ("[ERROR] Failed to execute goal org.example:plugin:1.0:run", "maven-goal", "build", 63, 0, 15, "^\\[ERROR\\] Failed to execute goal "),
    ("=== short test summary info ===", "pytest-summary", "test", 62, 0, 60, "^(FAILED|ERROR) "),
    ("--- FAIL: TestLedger (0.42s)", "go-test-fail", "test", 60, 8, 20, "^--- FAIL: "),
    ('Exception in thread "main" java.lang.IllegalStateException: no', "java-exception", "build", 58, 0, -1, "^Exception in thread|^Caused by: "),
    ("E    AssertionError: assert 1 == 2", "pytest-traceback", "test", 56, 15, 2, "^E   [^ ]|^E\\s\\s\\s[^ ]"),
    ("##[error]Dependency review found a problem", "annotation-error", "unknown", 34, 8, 2, "^##\\[error\\]"),
    ("nothing of note", "exit-code", "unknown", 10, 20, 0, "Process completed with exit code"),
)
EXIT_LINE = "##[error]Process completed with exit code 1."


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ci_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each event: users are people, their days are commits, errors are failures."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    started = F.col("ts").cast("timestamp")
    millis = F.round(F.col("value") * 100).cast("long") * 600
    error = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("ord"),
        F.col("event_id").cast("string").alias("run_id"),
        F.lit(1).alias("attempt"),
        F.lit("r").alias("repo"),
        F.lit("ci").alias("workflow"),
        F.concat(F.lit("job"), (F.col("user_id") % 5).cast("string")).alias("job"),
        F.concat(F.lit("b"), (F.col("user_id") % 6).cast("string")).alias("branch"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("commit"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"),
        F.when(error & (k < 20), "cancelled")
        .when(error & (k >= 80), "timed_out")
        .when(error, "failure")
        .when(F.col("event_type") == "view", "neutral")
        .when(F.col("event_type") == "click", "skipped")
        .otherwise("success")
        .alias("api_conclusion"),
        F.element_at(F.array(F.lit("macOS-14"), F.lit("windows-2022"), F.lit("ubuntu-22.04"), F.lit("private")), k % 4 + 1).alias("runner"),
        F.element_at(F.array(*[F.lit(c) for c in ("test", "build", "dependency", "infrastructure", "resource", "timeout", "unknown")]), k % 7 + 1).alias("category"),
        started.alias("started_at"),
        F.timestamp_micros(F.unix_micros(started) + millis * 1000).alias("completed_at"),
    )


#: White space within a line, in the words of DuckDB's expressions.
BLANKS = r"[ \t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

RUNS_SQL = """
WITH e AS (SELECT *, cast(json_extract_string(props, '$.k') AS int) AS k FROM events),
runs0 AS (
  SELECT event_id AS ord, cast(event_id AS varchar) AS run_id, 1 AS attempt, 'job' || (user_id % 5) AS job, 'b' || (user_id % 6) AS branch,
         user_id || ':' || strftime(ts, '%Y-%m-%d') AS commit, 'u' || user_id AS actor, ts AS started_at,
         CASE WHEN event_type = 'error' AND k < 20 THEN 'cancelled' WHEN event_type = 'error' AND k >= 80 THEN 'timed_out'
              WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS conclusion,
         CASE k % 4 WHEN 0 THEN 10 WHEN 1 THEN 2 ELSE 1 END AS price,
         (['test', 'build', 'dependency', 'infrastructure', 'resource', 'timeout', 'unknown'])[k % 7 + 1] AS category,
         greatest(0, cast(round(value * 100) AS bigint) * 600000) AS wall_micros FROM e),
runs AS (SELECT *, cast(wall_micros * price AS bigint) AS billable_micros FROM runs0),
failures AS (SELECT * FROM runs WHERE conclusion <> 'success')
"""


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def ci_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, log): a group around the text and a failure line, the exit code line, and what comes after."""
    lines = F.array(*[F.lit(p[0]) for p in PLANTED])
    chosen = F.element_at(lines, (F.col("doc_id") % len(PLANTED) + 1).cast("int"))
    parts = [F.lit("##[group]Run step\n"), _text(), F.lit("\n"), chosen, F.lit(f"\n##[endgroup]\n{EXIT_LINE}\nCleaning up\n")]
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("log"))


#: Blocks of lines with open and close marks, several anchors, or none; chosen by the remainder of the id.
BLOCKS = (
    "=== RUN   TestA\nstep one\n--- FAIL: TestA (0.01s)\n    detail\n=== RUN   TestB\nok\n--- FAIL: TestB (0.02s)\nmore\nPASS",
    "#7 [2/4]\n > [build 2/4] RUN make:\n0.5 cc\nERROR: failed to solve: process\nafter",
    "npm ERR! code E404\nnpm ERR! 404 gone\nnpm ERR! A complete log of this run can be found in:\nend\nnpm ERR! code E500\nlast",
    "_______ test_x _______\nassert\nE    AssertionError\nline\n##[group]inner\nE    again",
    "panic: a\ngoroutine 1\nFAIL\tpkg\npanic: b",
    "FAILURE: Build failed with an exception.\n> Task\n* Try:\n> more\n##[error]Bad thing",
    "##[endgroup]\nnothing at all",
)


def marked_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, log): a group that never ends, a group around the text and a block of marks, the text again, an unclosed group."""
    chosen = F.element_at(F.array(*[F.lit(x) for x in BLOCKS]), (F.col("doc_id") % len(BLOCKS) + 1).cast("int"))
    parts = [F.lit("##[group]  Set up \t\nready\n##[group]\u00a0Run tests\n"), _text(), F.lit("\n"), chosen, F.lit("\n##[endgroup]  \n"), _text(), F.lit(f"\n{EXIT_LINE}\n##[group]Post")]
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("log"))


def noisy_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, log): the text with colours, time stamps and progress marks at every line."""
    text = F.replace(_text(), F.lit("\n"), F.lit(f"\x1b[0m  \n{STAMPED}10%\r60%\r"))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(f"{STAMPED}\x1b[1;31m"), text, F.lit("\r\n\n \n")).alias("log"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LOGS_SQL = f"""
WITH planted AS (SELECT * FROM (VALUES {", ".join(f"({i}, {', '.join(_quoted(x) if isinstance(x, str) else str(x) for x in p)})" for i, p in enumerate(PLANTED))})
  t(i, line, rule, category, weight, before, after, told)),
logs AS (
  SELECT doc_id, i, line, rule, category, weight, before, after, told,
         string_split('##[group]Run step' || chr(10) || coalesce(text, '') || chr(10) || line || chr(10)
           || '##[endgroup]' || chr(10) || '{EXIT_LINE}' || chr(10) || 'Cleaning up', chr(10)) AS raw
  FROM documents JOIN planted ON doc_id % {len(PLANTED)} = i),
clean AS (SELECT *, list_transform(raw, lambda x: regexp_replace(x, '{BLANKS}+$', '')) AS lines FROM logs),
placed AS (SELECT *, len(lines) - 1 AS last, len(lines) - 4 AS anchor0 FROM clean),
spans AS (
  SELECT *, CASE WHEN rule = 'exit-code' THEN last - 1 ELSE anchor0 END AS anchor FROM placed),
bounded AS (
  SELECT *, greatest(0, anchor - before) AS start_line,
         CASE WHEN rule = 'exit-code' OR after = -1 THEN anchor ELSE least(anchor0 + 1, anchor + after) END AS end_line FROM spans)
"""
NOISY_SQL = f"""
WITH noisy AS (
  SELECT doc_id, string_split(replace('{STAMPED}' || chr(27) || '[1;31m' || replace(coalesce(text, ''), chr(10),
         chr(27) || '[0m  ' || chr(10) || '{STAMPED}10%' || chr(13) || '60%' || chr(13)) || chr(13) || chr(10) || chr(10) || ' ' || chr(10), chr(13) || chr(10), chr(10)), chr(10)) AS raw
  FROM documents),
ansi AS (SELECT doc_id, list_transform(raw, lambda x: regexp_replace(x, '\\x1b\\[[0-9;]*[A-Za-z]', '', 'g')) AS a FROM noisy),
stamp AS (SELECT doc_id, list_transform(a, lambda x: regexp_replace(x, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d+Z ?', '')) AS a FROM ansi),
frame AS (SELECT doc_id, list_transform(a, lambda x: regexp_replace(x, '^.*\\r', '')) AS a FROM stamp),
stripped AS (SELECT doc_id, list_transform(a, lambda x: regexp_replace(x, '{BLANKS}+$', '')) AS a FROM frame)
"""
MARKED_SQL = f"""
WITH blocks AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_quoted(x)})" for i, x in enumerate(BLOCKS))}) t(k, block)),
raw AS (
  SELECT doc_id, string_split('##[group]  Set up ' || chr(9) || chr(10) || 'ready' || chr(10) || '##[group]' || chr(160) || 'Run tests' || chr(10) || coalesce(text, '') || chr(10)
         || block || chr(10) || '##[endgroup]  ' || chr(10) || coalesce(text, '') || chr(10) || '{EXIT_LINE}' || chr(10) || '##[group]Post', chr(10)) AS r
  FROM documents JOIN blocks ON doc_id % {len(BLOCKS)} = k),
lines AS (
  SELECT doc_id, i, regexp_replace(x, '{BLANKS}+$', '') AS x, n
  FROM (SELECT doc_id, unnest(r) AS x, generate_subscripts(r, 1) - 1 AS i, len(r) AS n FROM raw)),
marks AS (
  SELECT doc_id, i, n, starts_with(x, '##[group]') AS opens, regexp_replace(regexp_replace(x[10:], '^{BLANKS}+', ''), '{BLANKS}+$', '') AS name
  FROM lines WHERE starts_with(x, '##[group]') OR x = '##[endgroup]'),
bounds AS (
  SELECT doc_id, i AS first_line, opens, name, coalesce(lead(i - opens::int) OVER (PARTITION BY doc_id ORDER BY i), n - 1) AS last_line FROM marks),
groups AS (SELECT doc_id, name, first_line, last_line FROM bounds WHERE opens)
"""
