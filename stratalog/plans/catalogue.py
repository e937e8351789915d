"""The registered queries of the failure-analytics engine and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import logtext
from stratalog.functions import runs as R
from stratalog.functions.rules import RULES
from stratalog.operators import clustering, cost, evidence, extraction
from stratalog.plans.tables import BLANKS, LOGS_SQL, MARKED_SQL, NOISY_SQL, RUNS_SQL, ci_logs, ci_runs, marked_logs, noisy_logs, read
from stratalog.sources import api, manifest

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_ORACLES)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.priced(ci_runs(spark, sf_dir).withColumn("conclusion", R.outcome(F.col("api_conclusion"))))


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).where(R.failed(F.col("conclusion")))


COST_COLUMNS = ["occurrences", "wall_micros", "billable_micros", "people_blocked", "branches_blocked"]
_COST_SQL = """cast(count(*) AS bigint) AS occurrences, cast(sum(wall_micros) AS bigint) AS wall_micros, cast(sum(billable_micros) AS bigint) AS billable_micros,
       cast(count(DISTINCT actor) AS bigint) AS people_blocked, cast(count(DISTINCT branch) AS bigint) AS branches_blocked"""


@_query(RUNS_SQL + "SELECT run_id, conclusion FROM runs")
def conclusion_map(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", "conclusion")


@_query(RUNS_SQL + "SELECT run_id, cast(price AS bigint) AS multiplier FROM runs")
def runner_multiplier(spark, sf_dir):
    return ci_runs(spark, sf_dir).select("run_id", R.runner_multiplier(F.col("runner")).alias("multiplier"))


@_query(RUNS_SQL + "SELECT run_id, wall_micros, billable_micros, wall_micros / 1e6 AS wall_seconds FROM runs")
def run_cost(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", "wall_micros", "billable_micros", cost.seconds(F.col("wall_micros")).alias("wall_seconds"))


@_query(RUNS_SQL + "SELECT run_id, conclusion, wall_micros, billable_micros FROM failures")
def failed_filter(spark, sf_dir):
    return _failures(spark, sf_dir).select("run_id", "conclusion", "wall_micros", "billable_micros")


@_query(RUNS_SQL + "SELECT run_id FROM runs WHERE started_at >= TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 10 DAY")
def since_filter(spark, sf_dir):
    return manifest.since(_runs(spark, sf_dir), 10, "2024-01-25 12:00:00").select("run_id")


@_query(RUNS_SQL + f"SELECT job, {_COST_SQL} FROM failures GROUP BY job")
def cost_by_job(spark, sf_dir):
    return cost.cost_by(_failures(spark, sf_dir), "job")


@_query(RUNS_SQL + f"SELECT actor, {_COST_SQL} FROM failures GROUP BY actor")
def cost_by_actor(spark, sf_dir):
    return cost.cost_by(_failures(spark, sf_dir), "actor")


@_query(RUNS_SQL + "SELECT commit, cast(count(DISTINCT actor) AS bigint) AS people, cast(count(DISTINCT branch) AS bigint) AS branches FROM failures GROUP BY commit")
def distinct_people_branches(spark, sf_dir):
    costs = cost.cost_by(_failures(spark, sf_dir), "commit")
    return costs.select("commit", F.col("people_blocked").alias("people"), F.col("branches_blocked").alias("branches"))


def _ranking(by: str, order: str):
    def query(spark, sf_dir):
        return cost.ranked(cost.cost_by(_failures(spark, sf_dir), "actor"), by, "actor", top=20)

    query.__name__ = f"rank_by_{by}"
    sql = f"c AS (SELECT actor, {_COST_SQL} FROM failures GROUP BY actor) SELECT *, cast(row_number() OVER (ORDER BY {order}) AS int) AS rank FROM c ORDER BY {order} LIMIT 20"
    _query(RUNS_SQL + ", " + sql)(query)


_ranking("cost", "billable_micros DESC, actor")
_ranking("occurrences", "occurrences DESC, actor")
_ranking("people", "people_blocked DESC, billable_micros DESC, actor")


@_query(RUNS_SQL + "SELECT job, sum(billable_micros)::double / (SELECT sum(billable_micros) FROM failures)::double AS part FROM failures GROUP BY job")
def share_of_total(spark, sf_dir):
    costs = cost.cost_by(_failures(spark, sf_dir), "job")
    whole = costs.agg(F.sum("billable_micros").alias("whole"))
    return costs.crossJoin(F.broadcast(whole)).select("job", R.share(F.col("billable_micros"), F.col("whole")).alias("part"))


@_query(
    RUNS_SQL
    + """SELECT count(*) AS runs, count(*) FILTER (conclusion <> 'success') AS failed_runs, count(*) FILTER (conclusion = 'success') AS succeeded_runs,
       cast(coalesce(sum(wall_micros) FILTER (conclusion <> 'success'), 0) AS bigint) AS wall_micros,
       cast(coalesce(sum(billable_micros) FILTER (conclusion <> 'success'), 0) AS bigint) AS billable_micros,
       epoch_us(min(started_at)) AS window_start, epoch_us(max(started_at)) AS window_end FROM runs"""
)
def totals(spark, sf_dir):
    out = cost.totals(_runs(spark, sf_dir))
    return out.withColumns({c: F.unix_micros(c) for c in ("window_start", "window_end")})


@_query(
    RUNS_SQL
    + """SELECT coalesce(sum(CASE WHEN category IN ('infrastructure', 'resource', 'timeout') THEN billable_micros ELSE 0 END)::double
       / nullif(sum(billable_micros), 0)::double, 0.0) AS part FROM failures"""
)
def infra_share(spark, sf_dir):
    return _failures(spark, sf_dir).agg(cost.infrastructure_share().alias("part"))


@_query(RUNS_SQL + "SELECT actor, epoch_us(min(started_at)) AS first_seen, epoch_us(max(started_at)) AS last_seen, array_to_string(list_sort(list(DISTINCT job)), ',') AS jobs FROM failures GROUP BY actor")
def seen_and_jobs(spark, sf_dir):
    return _failures(spark, sf_dir).groupBy("actor").agg(
        F.unix_micros(F.min("started_at")).alias("first_seen"),
        F.unix_micros(F.max("started_at")).alias("last_seen"),
        F.array_join(F.array_sort(F.collect_set("job")), ",").alias("jobs"),
    )


_JUDGED_SQL = (
    RUNS_SQL
    + """, judged AS (
  SELECT f.run_id, f.actor, f.job, f.commit, max(p.started_at) FILTER (p.conclusion = 'success') AS passed_at,
         arg_max(p.run_id, p.started_at) FILTER (p.conclusion = 'success') AS pass,
         string_agg(p.run_id || '#1', ',' ORDER BY p.run_id || '#1') FILTER (p.conclusion <> 'success') AS again
  FROM failures f LEFT JOIN runs p ON f.commit = p.commit AND f.job = p.job AND f.run_id <> p.run_id GROUP BY ALL),
verdicts AS (SELECT *, CASE WHEN pass IS NOT NULL THEN 'flaky' WHEN again IS NOT NULL THEN 'deterministic' ELSE 'unproven' END AS verdict FROM judged)
"""
)


def _judged(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return evidence.classify(runs.where(R.failed(F.col("conclusion"))), runs)


@_query(
    _JUDGED_SQL
    + """SELECT run_id, verdict, CASE verdict WHEN 'flaky' THEN pass || '#1' WHEN 'deterministic' THEN again ELSE '' END AS proof,
       CASE verdict WHEN 'flaky' THEN 'another run of ' || job || ' on ' || left(commit, 8) || ' passed unchanged'
         WHEN 'deterministic' THEN job || ' failed again on ' || left(commit, 8) || ' without a change'
         ELSE left(commit, 8) || ' was never re-run, so nothing proves either way' END AS reason FROM verdicts"""
)
def classify_runs(spark, sf_dir):
    judged = evidence.with_proof(_judged(spark, sf_dir), _runs(spark, sf_dir))
    return judged.select("run_id", "verdict", F.array_join("proof", ",").alias("proof"), "reason")


@_query(
    RUNS_SQL
    + """SELECT f.ord, count(*) AS peers, count(*) FILTER (p.conclusion = 'success') AS passed, min(p.run_id || '#1') AS first_peer
       FROM failures f JOIN runs p ON f.commit = p.commit AND f.job = p.job AND f.run_id <> p.run_id GROUP BY f.ord"""
)
def outcome_peers(spark, sf_dir):
    found = evidence.peers(_failures(spark, sf_dir), _runs(spark, sf_dir))
    return found.groupBy("ord").agg(F.count(F.lit(1)).alias("peers"), F.count_if("passed").alias("passed"), F.min("peer").alias("first_peer"))


@_query(_JUDGED_SQL + "SELECT verdict, count(*) AS n FROM verdicts GROUP BY verdict")
def verdict_counts(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@_query(
    _JUDGED_SQL
    + """, c AS (SELECT actor, count(*) FILTER (verdict = 'flaky') AS f, count(*) FILTER (verdict = 'deterministic') AS d FROM verdicts GROUP BY actor)
SELECT actor, CASE WHEN f > 0 AND f >= d THEN 'flaky' WHEN d > 0 THEN 'deterministic' ELSE 'unproven' END AS verdict FROM c"""
)
def cluster_verdict(spark, sf_dir):
    counts = _judged(spark, sf_dir).groupBy("actor").agg(F.count_if(F.col("verdict") == "flaky").alias("f"), F.count_if(F.col("verdict") == "deterministic").alias("d"))
    return counts.select("actor", evidence.verdict_of(F.col("f"), F.col("d")).alias("verdict"))


@_query(
    RUNS_SQL
    + """SELECT run_id, CASE WHEN s < 60 THEN printf('%.0f', s) || 's' WHEN s / 60 < 90 THEN printf('%.0f', s / 60) || 'm' ELSE printf('%.1f', s / 3600) || 'h' END AS told
FROM (SELECT run_id, billable_micros / 1e6 AS s FROM runs)"""
)
def format_duration(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", R.format_duration(cost.seconds(F.col("billable_micros"))).alias("told"))


@_query("SELECT cast(event_id AS varchar) AS run_id, 1 AS attempt, event_type AS workflow, 'u' || user_id AS actor, '' AS branch FROM events")
def api_run_projection(spark, sf_dir):
    payload = F.to_json(
        F.struct(F.col("event_id").alias("id"), F.lit("").alias("path"), F.col("event_type").alias("name"), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("login")).alias("actor"))
    )
    payloads = read(spark, sf_dir, "events").select(payload.alias("payload"))
    return api.workflow_runs(payloads).select("run_id", "attempt", "workflow", "actor", "branch")


# Logs ----------------------------------------------------------------------------------------------


def _joined(step):
    """A step of cleaning applied to every raw line, up to that step."""
    return lambda log: F.array_join(F.transform(F.split(F.replace(log, F.lit("\r\n"), F.lit("\n")), "\n", -1), step), "\n")


@_query(NOISY_SQL + "SELECT doc_id, md5(array_to_string(a, chr(10))) AS cleaned FROM ansi")
def strip_ansi(spark, sf_dir):
    return extraction.spread(noisy_logs(spark, sf_dir)).select("doc_id", F.md5(_joined(logtext.strip_ansi)(F.col("log"))).alias("cleaned"))


@_query(NOISY_SQL + "SELECT doc_id, md5(array_to_string(a, chr(10))) AS cleaned FROM stamp")
def strip_timestamp(spark, sf_dir):
    step = lambda x: logtext.strip_timestamp(logtext.strip_ansi(x))
    return extraction.spread(noisy_logs(spark, sf_dir)).select("doc_id", F.md5(_joined(step)(F.col("log"))).alias("cleaned"))


@_query(NOISY_SQL + "SELECT doc_id, md5(array_to_string(a, chr(10))) AS cleaned FROM frame")
def cr_collapse(spark, sf_dir):
    step = lambda x: logtext.last_frame(logtext.strip_timestamp(logtext.strip_ansi(x)))
    return extraction.spread(noisy_logs(spark, sf_dir)).select("doc_id", F.md5(_joined(step)(F.col("log"))).alias("cleaned"))


@_query(
    NOISY_SQL
    + """, ends AS (SELECT doc_id, a, coalesce(list_max(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] <> '' THEN i ELSE 0 END)), 0) AS n FROM stripped)
SELECT doc_id, n AS n_lines, md5(array_to_string(a[1:n], chr(10))) AS cleaned FROM ends"""
)
def clean_log(spark, sf_dir):
    lines = extraction.spread(noisy_logs(spark, sf_dir)).select("doc_id", logtext.clean_lines(F.col("log")).alias("lines"))
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("cleaned"))


@_query(MARKED_SQL + "SELECT doc_id, name, cast(first_line AS int) AS first_line, cast(last_line AS int) AS last_line FROM groups")
def sections(spark, sf_dir):
    found = extraction.with_lines(marked_logs(spark, sf_dir)).select("doc_id", F.explode("sections").alias("s"))
    return found.select("doc_id", "s.name", F.col("s.start").alias("first_line"), F.col("s.end").alias("last_line"))


@_query(LOGS_SQL + "SELECT doc_id, count(*) FILTER (i <= anchor0 + 1) AS inside, count(*) FILTER (i > anchor0 + 1) AS outside FROM (SELECT doc_id, anchor0, unnest(range(0, last + 1)) AS i FROM placed) GROUP BY doc_id")
def enclosing_section(spark, sf_dir):
    logs = extraction.with_lines(ci_logs(spark, sf_dir))
    hit = F.expr(f"transform(lines, (x, i) -> cast({logtext.enclosing_sql('sections', 'i')} IS NOT NULL AS bigint))")
    total = F.aggregate(hit, F.lit(0).cast("long"), lambda s, x: s + x)
    return logs.select("doc_id", total.alias("inside"), (F.size("lines") - total).alias("outside"))


@_query(LOGS_SQL + "SELECT doc_id, rule, cast(start_line AS int) AS start_line, cast(end_line AS int) AS end_line, cast(anchor AS int) AS anchor FROM bounded UNION SELECT doc_id, 'exit-code', cast(greatest(0, last - 21) AS int), cast(last - 1 AS int), cast(last - 1 AS int) FROM bounded")
def greedy_candidates(spark, sf_dir):
    logs = extraction.with_lines(ci_logs(spark, sf_dir))
    found = logs.select("doc_id", F.explode(extraction.candidates()).alias("c"))
    return found.select("doc_id", "c.rule", F.col("c.start").alias("start_line"), F.col("c.end").alias("end_line"), "c.anchor")


@_query(LOGS_SQL + "SELECT rule, count(*) AS n FROM (SELECT doc_id, rule FROM bounded UNION SELECT doc_id, 'exit-code' FROM bounded) GROUP BY rule")
def rule_counts(spark, sf_dir):
    logs = extraction.with_lines(ci_logs(spark, sf_dir))
    each = [f"CASE WHEN exists(lines, x -> {logtext.matches_line_sql('x', r.anchor)}) THEN '{r.name}' END" for r in RULES]
    fired = F.expr(f"array_compact(array({', '.join(each)}))")
    return logs.select(F.explode(fired).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _like_sql(pattern: str) -> str:
    """A condition on the line ``x`` in DuckDB's expressions, which know no lookahead: it becomes a condition of its own."""
    if "(?!" not in pattern:
        return f"regexp_matches(x, {_quote(pattern)})"
    if pattern.startswith(r"^(?!"):
        return r"NOT regexp_matches(x, '^\s*(at |\.\.\.|Caused by:|Suppressed:)') AND regexp_matches(x, '^\S')"
    before, rest = pattern.split("(?!", 1)
    never, after = rest.split(")", 1)
    return f"regexp_matches(x, {_quote(before + after)}) AND NOT regexp_matches(x, {_quote(before + never)})"


def _hits_sql(rules) -> str:
    """anchors(doc_id, rule, anchor, start_line, end_line) of the rules on the marked logs, by joins of line numbers."""
    parts = []
    for r in rules:
        opens = f"SELECT max(o.i) FROM lines o WHERE o.doc_id = a.doc_id AND o.i <= a.anchor AND o.i >= greatest(a.floor, a.anchor - {r.max_back}) AND ({_like_sql(r.open).replace('(x,', '(o.x,')})" if r.open else "NULL"
        closes = f"SELECT min(c.i) FROM lines c WHERE c.doc_id = a.doc_id AND c.i > a.anchor AND c.i <= least(a.ceiling, a.anchor + {r.max_forward}) AND ({_like_sql(r.close).replace('(x,', '(c.x,')})" if r.close else "NULL"
        closed = "closed" if r.close_inclusive else "greatest(anchor, closed - 1)"
        parts.append(
            f"""SELECT doc_id, '{r.name}' AS rule, anchor, coalesce(opened, greatest(floor, anchor - {r.before})) AS start_line,
  coalesce({closed}, least(ceiling, anchor + {r.after})) AS end_line
  FROM (SELECT a.*, ({opens}) AS opened, ({closes}) AS closed FROM (
    SELECT l.doc_id, l.i AS anchor, coalesce(g.first_line, 0) AS floor, coalesce(g.last_line, l.n - 1) AS ceiling
    FROM lines l LEFT JOIN groups g ON l.doc_id = g.doc_id AND l.i BETWEEN g.first_line AND g.last_line WHERE {_like_sql(r.anchor).replace('(x,', '(l.x,')}) a)"""
        )
    return MARKED_SQL + ", anchors AS (" + "\nUNION ALL ".join(parts) + ")\n"


@_query(_hits_sql(RULES) + "SELECT rule, doc_id, count(*) AS n, cast(min(anchor) AS int) AS first_anchor FROM anchors GROUP BY ALL")
def rule_hits(spark, sf_dir):
    logs = extraction.with_lines(marked_logs(spark, sf_dir))

    hits = [f"transform({logtext.indices_sql('lines', r.anchor)}, k -> named_struct('rule', '{r.name}', 'i', k))" for r in RULES]
    found = logs.select("doc_id", F.explode(F.expr(f"flatten(array({', '.join(hits)}))")).alias("m"))
    return found.groupBy("m.rule", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("m.i").alias("first_anchor"))


_OPENING = [r for r in RULES if r.open]
_CLOSING = [r for r in RULES if r.close]


def _anchored(spark, sf_dir, rules):
    logs = extraction.with_lines(marked_logs(spark, sf_dir))
    found = extraction.candidates(rules, extraction.anchor_spans)
    return logs.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.rule", "c.anchor", F.col("c.start").alias("start_line"), F.col("c.end").alias("end_line"))


@_query(_hits_sql(_OPENING) + "SELECT doc_id, rule, cast(anchor AS int) AS anchor, cast(start_line AS int) AS start_line FROM anchors")
def scan_back(spark, sf_dir):
    return _anchored(spark, sf_dir, _OPENING).drop("end_line")


@_query(_hits_sql(_CLOSING) + "SELECT doc_id, rule, cast(anchor AS int) AS anchor, cast(end_line AS int) AS end_line FROM anchors")
def scan_forward(spark, sf_dir):
    return _anchored(spark, sf_dir, _CLOSING).drop("start_line")


@_query(
    _hits_sql(RULES).replace("WITH blocks", "WITH RECURSIVE blocks", 1)
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule ORDER BY anchor) AS k FROM anchors),
walk AS (
  SELECT doc_id, rule, k, start_line, end_line, anchor, true AS kept, end_line AS until FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.doc_id, n.rule, n.k, n.start_line, n.end_line, n.anchor, n.anchor > w.until, CASE WHEN n.anchor > w.until THEN n.end_line ELSE w.until END
  FROM walk w JOIN numbered n ON n.doc_id = w.doc_id AND n.rule = w.rule AND n.k = w.k + 1)
SELECT doc_id, rule, cast(start_line AS int) AS start_line, cast(end_line AS int) AS end_line, cast(anchor AS int) AS anchor FROM walk WHERE kept"""
)
def greedy_marked(spark, sf_dir):
    logs = extraction.with_lines(marked_logs(spark, sf_dir))
    found = logs.select("doc_id", F.explode(extraction.candidates()).alias("c"))
    return found.select("doc_id", "c.rule", F.col("c.start").alias("start_line"), F.col("c.end").alias("end_line"), "c.anchor")


@_query(
    LOGS_SQL
    + """SELECT doc_id, rule, category, weight, cast(start_line AS int) AS start_line, cast(end_line AS int) AS end_line,
       md5(array_to_string(lines[start_line + 1:end_line + 1], chr(10))) AS body,
       trim(coalesce(list_filter(lines[start_line + 1:end_line + 1], lambda x: regexp_matches(x, told))[1], lines[anchor + 1]), ' ' || chr(9)) AS summary FROM bounded"""
)
def best_span(spark, sf_dir):
    spans = extraction.extract(ci_logs(spark, sf_dir), exit_code=None)
    return spans.select("doc_id", "span.rule", "span.category", "span.weight", "span.start_line", "span.end_line", F.md5(F.array_join("span.lines", "\n")).alias("body"), "span.summary")


@_query(
    f"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS r FROM documents),
c AS (SELECT doc_id, list_transform(r, lambda x: regexp_replace(x, '{BLANKS}+$', '')) AS a FROM t),
f AS (SELECT doc_id, a, list_filter(list_transform(range(0, len(a)), lambda i: CASE WHEN a[i + 1] <> '' THEN i ELSE -1 END), lambda i: i >= 0) AS filled FROM c)
SELECT doc_id, CASE WHEN len(filled) = 0 THEN 0 ELSE cast(filled[greatest(1, len(filled) - 24)] AS int) END AS start_line,
       CASE WHEN len(filled) = 0 THEN 0 ELSE cast(filled[len(filled)] AS int) END AS end_line,
       CASE WHEN len(filled) = 0 THEN 'empty log' ELSE 'no rule matched, showing the tail (exit code 3)' END AS summary FROM f"""
)
def tail_span(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("log"), F.lit(3).alias("exit_code"))
    spans = extraction.extract(docs)
    return spans.select("doc_id", "span.start_line", "span.end_line", "span.summary")


def _prints(spark, sf_dir):
    return extraction.normalised(extraction.extract(ci_logs(spark, sf_dir), exit_code=None))


#: The substitutions in RE2's words: two lookaheads are spelt out with a group.
_RE2_STEPS = [
    (p.replace(r"(?=\S)", r"(\S)").replace(r"(?=[\s,)\]]|$)", r"([\s,)\]]|$)"), (by + r"\1" if r"(?=" in p else by.replace("$1", r"\1").replace("$2", r"\2").replace("~\\\\", "~\\\\")))
    for p, by in logtext.SUBSTITUTIONS
]


def _normalised_sql(line: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = line
    for p, by in logtext.COUNT_LINES:
        for n in "1234":
            by = by.replace(f"${n}", f"\\{n}")
        out = f"regexp_replace({out}, {quote(p)}, {quote(by)})"
    out = f"CASE WHEN regexp_matches({line}, {quote(logtext.BANNER)}) THEN regexp_replace({out}, {quote(logtext.BANNER_COUNT)}, '<N> \\2', 'g') ELSE {out} END"
    for p, by in _RE2_STEPS:
        out = f"regexp_replace({out}, {quote(p)}, {quote(by)}, 'g')"
    return f"trim(regexp_replace({out}, '[ \\t]+', ' ', 'g'), ' ')"


_NORMAL_SQL = (
    LOGS_SQL
    + f""", normal AS (SELECT doc_id, category, array_to_string(list_filter(list_transform(lines[start_line + 1:end_line + 1], lambda x: {_normalised_sql("x")}), lambda x: x <> ''), chr(10)) AS normalised FROM bounded)
"""
)


@_query(_NORMAL_SQL + "SELECT doc_id, md5(normalised) AS fingerprint, cast(length(normalised) AS int) AS n FROM normal")
def fingerprint_md5(spark, sf_dir):
    return _prints(spark, sf_dir).select("doc_id", F.md5("normalised").alias("fingerprint"), F.char_length("normalised").alias("n"))


@_query(_NORMAL_SQL + "SELECT md5(normalised) AS fingerprint, count(*) AS n, min(doc_id) AS first_ord FROM normal GROUP BY 1")
def exact_clusters(spark, sf_dir):
    prints = _prints(spark, sf_dir).groupBy(F.md5("normalised").alias("fingerprint"))
    return prints.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_ord"))


def _discriminators_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [f"list_transform(regexp_extract_all(normalised, {quote('(?m)' + p)}, 1), lambda v: '{k}:' || trim(v))" for k, p in logtext.DISCRIMINATORS]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return f"array_to_string(list_sort(list_distinct({out})), ' ')"


@_query(_NORMAL_SQL + f"SELECT doc_id, {_discriminators_sql()} AS tokens FROM normal")
def discriminators(spark, sf_dir):
    return _prints(spark, sf_dir).select("doc_id", F.array_join(F.expr(logtext.discriminators_sql("normalised")), " ").alias("tokens"))


@_query(_NORMAL_SQL + f"SELECT category, tokens, count(DISTINCT normalised) AS texts FROM (SELECT *, {_discriminators_sql()} AS tokens FROM normal) GROUP BY ALL")
def buckets(spark, sf_dir):
    prints = extraction.computed(_prints(spark, sf_dir), tokens=F.array_join(F.expr(logtext.discriminators_sql("normalised")), " "))
    return prints.groupBy(F.col("span.category").alias("category"), "tokens").agg(F.countDistinct("normalised").alias("texts"))


def _fingerprinted(spark, sf_dir):
    return extraction.fingerprinted(extraction.extract(ci_logs(spark, sf_dir), exit_code=None)).withColumn("ord", F.col("doc_id"))


@_query()
def similarity_pairs(spark, sf_dir):
    """Ratcliff-Obershelp similarity has no SQL form; tests hold it, and what follows from it, against loops."""
    return clustering.similar_pairs(clustering.fingerprints(_fingerprinted(spark, sf_dir)))


@_query()
def near_dup_clusters(spark, sf_dir):
    return clustering.clustered(_fingerprinted(spark, sf_dir)).select("doc_id", "digest", "cluster_id")


@_query(
    """WITH p AS (SELECT page_id, url, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS plain FROM pages)
SELECT a.page_id, min(b.url) AS member FROM p a JOIN p b ON a.plain = b.plain GROUP BY a.page_id"""
)
def job_log_select(spark, sf_dir):
    """For each page the first url of the same plain name, as a log is chosen for a job."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", manifest.plain_name(F.col("url")).alias("plain"))
    first = p.groupBy("plain").agg(F.min("url").alias("member"))
    return p.join(first, "plain").select("page_id", "member")


@_query()
def report_clusters(spark, sf_dir):
    """The whole plan: runs with logs, extraction, clustering, evidence, cost, ranking."""
    logs = ci_logs(spark, sf_dir)
    many = logs.count()
    logs = logs.withColumnRenamed("doc_id", "log_of")
    runs = ci_runs(spark, sf_dir).withColumn("conclusion", R.outcome(F.col("api_conclusion"))).drop("api_conclusion", "category")
    failing = runs.where(R.failed(F.col("conclusion")))
    with_logs = failing.join(logs, F.col("ord") % F.lit(max(many, 1)) == F.col("log_of"), "left").drop("log_of")
    with_logs = with_logs.withColumn("log", F.coalesce("log", F.lit(""))).withColumn("exit_code", F.lit(1))
    spans = extraction.fingerprinted(extraction.extract(cost.priced(with_logs))).drop("log")
    judged = evidence.classify(clustering.clustered(spans), runs)
    found = cost.clusters(judged)
    return found.select("cluster_id", "rule", "category", "verdict", *COST_COLUMNS, F.array_join("jobs", ",").alias("jobs"))
