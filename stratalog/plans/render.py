"""Writing a report as text, JSON or HTML. Only the rows that are shown come to the driver."""

from __future__ import annotations

import html
import itertools
import json

from pyspark.sql import functions as F

from stratalog.operators import cost
from stratalog.plans.report import Report, proven

VERDICTS = {"deterministic": "reproducible"}


def duration(s: float) -> str:
    if s < 60:
        return f"{s:.0f}s"
    return f"{s / 60:.0f}m" if s / 60 < 90 else f"{s / 3600:.1f}h"


def shorten(text: str, width: int, mark: str) -> str:
    flat = " ".join((text or "").split())
    return flat if len(flat) <= width else flat[: width - len(mark)] + mark


def _iso(moment) -> str | None:
    from datetime import UTC

    return None if moment is None else moment.replace(tzinfo=moment.tzinfo or UTC).isoformat()


def _top(report: Report, by: str, top: int | None):
    return cost.ranked(report.clusters, by, top=top).orderBy("rank").collect()


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def _window(totals) -> str:
    return "" if totals.window_start is None else f" between {totals.window_start:%Y-%m-%d} and {totals.window_end:%Y-%m-%d}"


def _split(c) -> str:
    """How a cluster's failures are judged, as one phrase."""
    told = {"flaky": c.proven_flaky, "reproducible": c.reproduced, "run once": c.never_rerun}
    return ", ".join(f"{what} {n}x" for what, n in told.items() if n)


#: The rankings: order, its title, and what of a cluster it shows.
RANKINGS = (
    ("cost", "machine time", lambda c: duration(c.billable_micros / 1e6)),
    ("occurrences", "frequency", lambda c: f"{c.occurrences}x"),
    ("people", "people held up", lambda c: f"{c.people_blocked} people"),
)


def _table(rows: list[tuple], head: tuple[str, ...], right: int) -> list[str]:
    """Rows under a head in columns as wide as needed, the first ``right`` of them flush right."""
    cells = [tuple(map(str, r)) for r in (head, *rows)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(head))]
    lines = ["  ".join(x.rjust(w) if i < right else x.ljust(w) for i, (x, w) in enumerate(zip(r, widths, strict=True))).rstrip() for r in cells]
    return [lines[0], "  ".join("=" * w for w in widths), *lines[1:]]


def as_text(report: Report, top: int = 10, spans: bool = False) -> str:
    """A summary and the costliest clusters in plain ASCII."""
    t = report.totals.first()
    seen = f"{t.runs} runs{_window(t)}"
    if not t.clusters:
        return f"{seen}, none failed.\nThere is nothing to rank.\n"
    out = [
        f"{seen}: {t.failed_runs} failed ({_share(t.failed_runs, t.runs):.0%}) for {t.clusters} causes.",
        f"They took {duration(t.wall_micros / 1e6)}, billed as {duration(t.billable_micros / 1e6)}; {t.not_our_code_share:.0%} of it is not the code's fault.",
        "",
        "COSTLIEST CAUSES",
    ]
    best = _top(report, "cost", top)
    rows = [
        (c.rank, duration(c.billable_micros / 1e6), f"{_share(c.billable_micros, t.billable_micros):.0%}", c.occurrences, c.people_blocked, c.cluster_id, VERDICTS.get(c.verdict, c.verdict), c.rule, shorten(c.summary, 64, "..."))
        for c in best
    ]
    out += [*_table(rows, ("rank", "billed", "part", "failures", "people", "cause", "judged", "rule", "what it says"), 5), "", "MORE ABOUT THEM"]
    about = [(c.cluster_id, c.category, f"{duration(c.mean_wall_seconds)} each", f"{c.first_seen:%Y-%m-%d} to {c.last_seen:%Y-%m-%d}", _split(c), " ".join(c.jobs)) for c in best]
    out += _table(about, ("cause", "category", "mean time", "seen", "judgements", "jobs"), 0)
    out += ["", "BY OTHER MEASURES"]
    out += _table([(title, " > ".join(f"{c.cluster_id} ({told(c)})" for c in _top(report, by, 3))) for by, title, told in RANKINGS[1:]], ("measure", "causes"), 0)
    if spans:
        out += ["", "LOG EXCERPTS"]
        for c in best:
            e = c.example
            out += [f"[{c.cluster_id}] {c.rule}, run {c.example_run_id}#{c.example_attempt}, from line {e.start_line} to {e.end_line}"]
            out += [f"{e.start_line + i:>6}: {line}" for i, line in enumerate(e.lines)]
    return "\n".join(out).encode("ascii", "replace").decode() + "\n"


# The keys of the JSON report and their order.
MEMBER_KEYS = ("run_id", "attempt", "job", "branch", "commit", "actor", "runner")


def _member(m) -> dict:
    return {
        **{k: m[k] for k in MEMBER_KEYS},
        "wall_seconds": round(m.wall_micros / 1e6, 1),
        "billable_seconds": round(m.billable_micros / 1e6, 1),
        "verdict": m.verdict,
        "evidence": m.reason,
        "proof": list(m.proof),
    }


def _cluster(c) -> dict:
    return {
        "id": c.cluster_id,
        **{k: c[k] for k in ("rule", "category", "summary", "verdict", "occurrences")},
        "wasted_wall_seconds": round(c.wall_micros / 1e6, 1),
        "wasted_billable_seconds": round(c.billable_micros / 1e6, 1),
        "mean_wall_seconds": round(c.mean_wall_seconds, 1),
        **{k: c[k] for k in ("people_blocked", "branches_blocked", "proven_flaky", "reproduced", "never_rerun")},
        "jobs": list(c.jobs),
        "first_seen": _iso(c.first_seen),
        "last_seen": _iso(c.last_seen),
        "example": {
            "run_id": c.last_member.run_id,
            "attempt": c.last_member.attempt,
            "start_line": c.example.start_line,
            "end_line": c.example.end_line,
            "text": "\n".join(c.example.lines),
        },
    }


def _totals(t) -> dict:
    return {
        **{k: t[k] for k in ("runs", "failed_runs", "succeeded_runs", "clusters")},
        "wasted_wall_seconds": round(t.wall_micros / 1e6, 1),
        "wasted_billable_seconds": round(t.billable_micros / 1e6, 1),
        "not_our_code_share": round(t.not_our_code_share, 4),
        "window_start": _iso(t.window_start),
        "window_end": _iso(t.window_end),
    }


def json_pieces(report: Report):
    """The whole report as JSON, piece by piece: clusters by cost, each followed by its members in order.

    Both are sorted by the cluster and come to the driver one partition at a time, so it never holds them all.
    """
    indented = lambda value, by: json.dumps(value, indent=2).replace("\n", "\n" + " " * by)
    yield '{\n  "schema": 1,\n  "totals": ' + indented(_totals(report.totals.first()), 2) + ',\n  "clusters": ['
    order = cost.ordering("cost")
    cost_of = report.clusters.select("cluster_id", F.col("billable_micros").alias("cluster_cost"))
    place = [F.desc("cluster_cost"), "cluster_id", "started_at", "first_ord", "ord"]
    members = proven(report).join(cost_of, "cluster_id").orderBy(*place).select("cluster_id", *MEMBER_KEYS, "wall_micros", "billable_micros", "verdict", "reason", "proof")
    by_cluster = itertools.groupby(members.toLocalIterator(), key=lambda m: m.cluster_id)
    between = ""
    for c in report.clusters.orderBy(*order).toLocalIterator():
        own, listed = next(by_cluster)
        assert own == c.cluster_id
        yield between + "\n    " + indented(_cluster(c), 4)[: -len("\n    }")] + ',\n      "occurrences_detail": ['
        comma = ""
        for m in listed:
            yield comma + "\n        " + indented(_member(m), 8)
            comma = ","
        yield "\n      ]\n    }"
        between = ","
    yield ("\n  ]" if between else "]") + "\n}\n"


def as_json(report: Report) -> str:
    return "".join(json_pieces(report))


STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{padding:4px 8px;text-align:left}.bar{background:#ccd;height:8px}pre{background:#f4f4f4;padding:8px}"


def as_html(report: Report, top: int = 20) -> str:
    """One page without scripts, links or outside resources; every text is escaped."""
    t, e = report.totals.first(), html.escape
    page = ['<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Failure report</title>', f"<style>{STYLE}</style></head><body>"]
    if not t.clusters:
        return "".join([*page, f"<h1>No failures</h1><p>{t.runs} runs{e(_window(t))}, none failed.</p></body></html>\n"])
    facts = (
        ("runs", t.runs), ("failed", t.failed_runs), ("distinct causes", t.clusters), ("wall", duration(t.wall_micros / 1e6)),
        ("billable", duration(t.billable_micros / 1e6)), ("not our code", f"{t.not_our_code_share:.0%}"),
    )
    page.append(f"<h1>Failures{e(_window(t))}</h1><dl>" + "".join(f"<dt>{k}</dt><dd>{e(str(v))}</dd>" for k, v in facts) + "</dl>")
    best = _top(report, "cost", top)
    peak = max(c.billable_micros for c in best) or 1
    page.append("<h2>Costliest causes</h2><table>")
    for c in best:
        cells = (str(c.rank), duration(c.billable_micros / 1e6), str(c.occurrences), str(c.people_blocked), VERDICTS.get(c.verdict, c.verdict), c.rule, shorten(c.summary, 110, "…"))
        page.append("<tr>" + "".join(f"<td>{e(x)}</td>" for x in cells) + f'<td><div class="bar" style="width:{100 * c.billable_micros / peak:.0f}px"></div></td></tr>')
    page.append("</table><h2>First by each measure</h2><table>")
    for by, title, told in RANKINGS:
        page.append(f"<tr><th>{title}</th><td>" + ", ".join(e(f"{c.cluster_id} ({told(c)})") for c in _top(report, by, 3)) + "</td></tr>")
    page.append("</table>")
    for c in best:
        page.append(f'<h3 id="{e(c.cluster_id)}">{e(c.rule)}: {e(shorten(c.summary, 110, "…"))}</h3><p>{e(c.category)}; {e(_split(c))}; jobs {e(", ".join(c.jobs))}</p>')
        page.append(f"<pre>{e(chr(10).join(c.example.lines))}</pre>")
    return "".join([*page, "</body></html>\n"])


def members_of(report: Report, cluster_id: str):
    return report.members.where(F.col("cluster_id") == cluster_id)
