"""Finding the span of a log that explains its failure.

Everything is row-local: the lines of a log are an array, the marks of a rule are arrays of line numbers,
and spans are built by higher-order functions, so a log is never shuffled but to deal a small input out to
all cores. A rule with any anchor yields a span, so the best span is among the rules of the heaviest weight
that fires: rules are tried in order of weight and lighter ones are not evaluated. A rule's expression is
tried only where the log, and then the line, holds a string that every match of it has.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import logtext
from stratalog.functions.rules import RULES, TAIL_LINES, TAIL_RULE, Rule

SPAN = "struct<rule:string,category:string,weight:int,start_line:int,end_line:int,summary:string,lines:array<string>>"


SPANS = "array<struct<start:int,end:int,anchor:int>>"


def _once(value: str, name: str, use: str) -> str:
    """``use`` with ``name`` standing for a value that is computed once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def anchor_spans(rule: Rule, lines: str = "lines", sections: str = "sections") -> str:
    """The span around each anchor of a rule as (start, end, anchor), whether or not it lies in an earlier one.

    It starts at the nearest open mark before the anchor and ends at the next close mark, where the rule has
    them and they are near enough, else a fixed number of lines away; it never leaves the anchor's section.
    """
    none = "cast(array() AS array<int>)"
    marks = (
        f"named_struct('anchors', {logtext.indices_sql(lines, rule.anchor)}, 'opens', {logtext.indices_sql(lines, rule.open) if rule.open else none}, "
        f"'closes', {logtext.indices_sql(lines, rule.close) if rule.close else none})"
    )
    bounds = f"named_struct('lo', coalesce(e.start, 0), 'hi', coalesce(e.end, size({lines}) - 1))"
    start = f"greatest(b.lo, a - {rule.before})"
    if rule.open:
        start = f"coalesce(array_max(filter(m.opens, o -> o <= a AND o >= greatest(b.lo, a - {rule.max_back}))), {start})"
    end = f"least(b.hi, a + {rule.after})"
    if rule.close:
        closed = f"array_min(filter(m.closes, c -> c > a AND c <= least(b.hi, a + {rule.max_forward})))"
        last = "c" if rule.close_inclusive else "greatest(a, c - 1)"
        end = _once(closed, "c", f"CASE WHEN c IS NULL THEN {end} ELSE {last} END")
    span = f"named_struct('start', cast({start} AS int), 'end', cast({end} AS int), 'anchor', cast(a AS int))"
    around = _once(logtext.enclosing_sql(sections, "a"), "e", _once(bounds, "b", span))
    return _once(marks, "m", f"transform(m.anchors, a -> {around})")


def rule_spans(rule: Rule, lines: str = "lines", sections: str = "sections") -> str:
    """All spans of a rule as (start, end, anchor): greedy from the top, anchors inside an earlier span skipped."""
    free = "s.anchor > t.until"
    keep = f"named_struct('until', CASE WHEN {free} THEN s.end ELSE t.until END, 'kept', CASE WHEN {free} THEN array_append(t.kept, s) ELSE t.kept END)"
    zero = f"named_struct('until', -1, 'kept', cast(array() AS {SPANS}))"
    return f"aggregate({anchor_spans(rule, lines, sections)}, {zero}, (t, s) -> {keep}, t -> t.kept)"


def _described(rule: Rule, lines: str) -> str:
    """The chosen span ``p`` as a struct ``SPAN``."""
    told = "w[p.anchor - p.start]"
    if rule.summary:
        told = f"coalesce(get(filter(w, x -> {logtext.matches_line_sql('x', rule.summary)}), 0), {told})"
    struct = (
        f"named_struct('rule', '{rule.name}', 'category', '{rule.category}', 'weight', {rule.weight}, 'start_line', p.start, 'end_line', p.end, "
        f"'summary', {logtext.trimmed_sql(told)}, 'lines', w)"
    )
    return _once(f"slice({lines}, p.start + 1, p.end - p.start + 1)", "w", struct)


def candidates(rules=RULES, spans=rule_spans) -> Column:
    """Spans of all rules as (rule, start, end, anchor), in order of rules and anchors, from the columns lines and sections."""
    named = [f"transform({spans(r)}, z -> named_struct('rule', '{r.name}', 'start', z.start, 'end', z.end, 'anchor', z.anchor))" for r in rules]
    return F.expr(f"flatten(array({', '.join(named)}))")


def _best_of(rules: list[Rule]) -> str:
    """Among rules of one weight the span that starts first; ties go to the earlier rule, then the earlier anchor."""
    keyed = [f"transform({rule_spans(r)}, z -> named_struct('start', z.start, 'k', {k}, 'anchor', z.anchor, 'end', z.end))" for k, r in enumerate(rules)]
    chosen = _described(rules[-1], "lines")
    for k, r in list(enumerate(rules))[:-1]:
        chosen = f"CASE WHEN p.k = {k} THEN {_described(r, 'lines')} ELSE {chosen} END"
    return _once(f"array_min(flatten(array({', '.join(keyed)})))", "p", chosen)


def _tail(exit_code: str) -> str:
    """The end of a log in which no rule fires: from the 25th last line that is not blank to the last."""
    filled = f"filter(transform(lines, (x, i) -> CASE WHEN {logtext.trimmed_sql('x')} <> '' THEN i END), i -> i IS NOT NULL)"
    ends = f"named_struct('a', coalesce(get(f, greatest(0, size(f) - {TAIL_LINES})), 0), 'z', coalesce(get(f, size(f) - 1), size(lines) - 1))"
    code = f"coalesce(concat(' (exit code ', cast({exit_code} AS string), ')'), '')"
    # fixed value: the words of the summary
    struct = (
        f"named_struct('rule', '{TAIL_RULE}', 'category', 'unknown', 'weight', 0, 'start_line', cast(g.a AS int), 'end_line', cast(g.z AS int), "
        f"'summary', concat('no rule matched, showing the tail', {code}), 'lines', slice(lines, g.a + 1, g.z - g.a + 1))"
    )
    return _once(filled, "f", _once(ends, "g", struct))


def _fires(rule: Rule) -> str:
    """Whether the rule has an anchor among the lines of the cleaned log."""
    return f"({logtext.may_match_sql('clean', rule.anchor)} AND exists(lines, x -> {logtext.matches_line_sql('x', rule.anchor)}))"


def best_span(exit_code: str) -> Column:
    """The span that explains the failure, as a struct ``SPAN``, from the columns ``clean``, ``lines`` and ``sections``."""
    empty = f"named_struct('rule', '{TAIL_RULE}', 'category', 'unknown', 'weight', 0, 'start_line', 0, 'end_line', 0, 'summary', 'empty log', 'lines', array())"
    cases = [f"WHEN size(lines) = 0 THEN cast({empty} AS {SPAN})"]
    ordered = sorted(RULES, key=lambda r: -r.weight)
    for _, same in itertools.groupby(ordered, key=lambda r: r.weight):
        group = list(same)
        cases.append(f"WHEN {' OR '.join(map(_fires, group))} THEN cast({_best_of(group)} AS {SPAN})")
    return F.expr(f"CASE {' '.join(cases)} ELSE cast({_tail(exit_code)} AS {SPAN}) END")


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row, however often later expressions name them.

    The optimiser folds a projection into the next one and may repeat its expressions there; it does not
    fold a generator, and a generator of one row adds neither rows nor a shuffle.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return rows.drop(*columns).select("*", made)


#: An input below so many bytes for each core is dealt out: a file's row group is read by one task.
SMALL_SHARE = 64 << 20


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a small input dealt to all cores; a large one comes in enough parts by itself."""
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < SMALL_SHARE * cores else rows


def with_lines(logs: DataFrame, log: str = "log") -> DataFrame:
    """Adds ``clean``, the cleaned log, its ``lines`` and ``sections``."""
    cleaned = computed(spread(logs), clean=logtext.clean_text(F.col(log)))
    split = computed(cleaned, lines=logtext.lines_of(F.col("clean")))
    none = F.array().cast("array<struct<name:string,start:int,end:int>>")
    return computed(split, sections=F.when(F.col("clean").contains("##[group]"), logtext.sections(F.col("lines"))).otherwise(none))


def extract(logs: DataFrame, log: str = "log", exit_code: str | None = "exit_code") -> DataFrame:
    """Adds ``span``; every log gets one."""
    rows = logs if exit_code in (None, "exit_code") else logs.withColumn("exit_code", F.col(exit_code))
    found = with_lines(rows, log)
    return computed(found, span=best_span("exit_code" if exit_code else "cast(null AS int)")).drop("clean", "lines", "sections")


def normalised(spans: DataFrame) -> DataFrame:
    """Adds the normalised text of ``span``."""
    return computed(spans, normalised=F.expr(logtext.normalise_sql("span.lines")))


def fingerprinted(spans: DataFrame) -> DataFrame:
    """Adds the normalised span text, its discriminators and its digest."""
    told = computed(normalised(spans), discriminators=F.expr(logtext.discriminators_sql("normalised")))
    return told.withColumn("digest", logtext.digest("normalised"))
