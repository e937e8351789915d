"""Column functions on log text: cleaning, sections, normalisation, discriminators and fingerprints.

Patterns keep the meaning of a Unicode-aware, newline-only regular expression: ``(?d)`` makes the line
feed the only line end, ``(?U)`` makes classes and word boundaries Unicode.

Large expressions are written as SQL text, from the same patterns: the text is parsed once, while every call
that builds a column is a message to the JVM. Functions that end in ``_sql`` take and return such text.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAGS = "(?dU)"
SPACE = r"[\s\x1c-\x1f]"
#: White space within a line.
BLANK = r"[\s\x1c-\x1f&&[^\n]]"

# What a runner adds to the lines of a log.
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z ?"
GROUP, END_GROUP = r"^##\[group\](.*)$", r"^##\[endgroup\]\s*$"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(FLAGS + pattern), F.lit(by))


def lines_replaced(text: Column, pattern: str, by: str) -> Column:
    """Replaces in every line of a text; the pattern must not match a line feed."""
    return F.regexp_replace(text, F.lit("(?m)" + FLAGS + pattern), F.lit(by))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return replaced(text, rf"^{SPACE}+|{SPACE}+\z", "")


def strip_ansi(line: Column) -> Column:
    return replaced(line, ANSI, "")


def strip_timestamp(line: Column) -> Column:
    return replaced(line, STAMP, "")


def last_frame(line: Column) -> Column:
    """What a progress line shows at last: the part behind its last carriage return."""
    return replaced(line, r"^.*\r", "")


def clean_line(line: Column) -> Column:
    return replaced(last_frame(strip_timestamp(strip_ansi(line))), rf"{SPACE}+\z", "")


def clean_text(text: Column) -> Column:
    """A whole log with every line cleaned, without empty lines at its end: the steps of ``clean_line`` over all lines at once."""
    raw = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    plain = F.when(raw.contains("\x1b"), replaced(raw, ANSI, "")).otherwise(raw)
    unstamped = lines_replaced(plain, STAMP, "")
    framed = F.when(unstamped.contains("\r"), lines_replaced(unstamped, r"^.*\r", "")).otherwise(unstamped)
    # from the first blank of a run, so that no run is looked at twice
    return F.rtrim(lines_replaced(framed, rf"(?<!{BLANK}){BLANK}++$", ""), F.lit("\n"))


def lines_of(clean: Column) -> Column:
    """The lines of a cleaned log; an empty one has none."""
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, "\n", -1))


def clean_lines(text: Column) -> Column:
    """The clean lines of a log, without empty ones at its end. A null log has none."""
    return F.transform(F.array(clean_text(text)), lines_of)[0]


def universal_newlines(text: Column) -> Column:
    """A text file's line ends as a text reader gives them: a lone carriage return ends a line too."""
    return F.regexp_replace(text, r"\r\n?", "\n")


@functools.lru_cache(maxsize=None)
def hints(pattern: str) -> tuple[str, ...] | None:
    """Strings one of which is in every text that matches, or None if the pattern does not tell.

    Of each alternative the longest run of plain characters is taken.
    """
    from re import _constants as op
    from re import _parser

    def runs(items) -> list[list[str]]:
        """For each alternative its runs of plain characters."""
        out: list[list[str]] = [[""]]
        for kind, value in items:
            if kind is op.LITERAL:
                for r in out:
                    r[-1] += chr(value)
            elif kind is op.BRANCH:
                inner = [x for branch in value[1] for x in runs(branch)]
                out = [[*r, *x, ""] for r in out for x in inner]
            elif kind is op.SUBPATTERN:
                inner = runs(value[3])
                out = [[*r, *x, ""] for r in out for x in inner]
            elif kind is op.MAX_REPEAT and value[0] > 0:
                inner = runs(value[2])
                out = [[*r, *x, ""] for r in out for x in inner]
            elif kind is not op.AT:
                for r in out:
                    r.append("")
        return out

    best = [max(r, key=len) for r in runs(_parser.parse(pattern))]
    return None if min(map(len, best)) < 3 else tuple(dict.fromkeys(best))


def quoted(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def matches_sql(text: str, pattern: str) -> str:
    return f"rlike({text}, {quoted(FLAGS + pattern)})"


def replaced_sql(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {quoted(FLAGS + pattern)}, {quoted(by)})"


def trimmed_sql(text: str) -> str:
    return replaced_sql(text, rf"^{SPACE}+|{SPACE}+\z", "")


def may_match_sql(text: str, pattern: str) -> str:
    """A cheap condition that every text with a match meets."""
    found = hints(pattern)
    return "true" if found is None else "(" + " OR ".join(f"contains({text}, {quoted(h)})" for h in found) + ")"


def matches_line_sql(line: str, pattern: str) -> str:
    """As ``matches``; the expression is tried only on lines that hold what it needs."""
    return f"({may_match_sql(line, pattern)} AND {matches_sql(line, pattern)})"


def indices_sql(lines: str, pattern: str) -> str:
    """0-based numbers of the lines that match."""
    return f"filter(transform({lines}, (x, i) -> CASE WHEN {matches_line_sql('x', pattern)} THEN i END), i -> i IS NOT NULL)"


def sections(lines: Column) -> Column:
    """array of (name, start, end) of the groups: each ends with its end marker, before the next group, or at the end."""

    def mark(x: Column, i: Column) -> Column:
        name = trimmed(F.regexp_extract(x, FLAGS + GROUP, 1))
        opened = F.struct(i.alias("at"), F.lit(True).alias("opens"), name.alias("name"))
        closed = F.struct(i.alias("at"), F.lit(False).alias("opens"), F.lit("").alias("name"))
        return F.when(~x.startswith("##["), None).when(matches(x, GROUP), opened).when(matches(x, END_GROUP), closed)

    marks = F.filter(F.transform(lines, mark), lambda m: m.isNotNull())
    return F.transform(F.array(marks), lambda ms: _spans(ms, F.size(lines)))[0]


def _spans(marks: Column, count: Column) -> Column:
    def span(m: Column, k: Column) -> Column:
        following = F.get(marks, k + 1)
        end = F.coalesce(following["at"] - following["opens"].cast("int"), count - 1)
        return F.when(m["opens"], F.struct(m["name"].alias("name"), m["at"].alias("start"), end.alias("end")))

    return F.filter(F.transform(marks, span), lambda s: s.isNotNull())


def enclosing_sql(found: str, at: str) -> str:
    """The section around a line, or null."""
    return f"get(filter({found}, s -> s.start <= {at} AND s.end >= {at}), 0)"


# What changes between runs of one failure, in the order in which it is replaced.
COUNT_LINES = (
    (r"^(\[(?:ERROR|INFO)\] Tests run: )\d+(, Failures: )\d+(, Errors: )\d+(, Skipped: )\d+", r"$1<N>$2<N>$3<N>$4<N>"),
    (r"^(ok|FAIL)(\s+\S+\s+)[\d.]+s$", r"$1$2<DUR>"),
)
BANNER, BANNER_COUNT = r"^=+ .* =+$", r"(\d+) (failed|passed|skipped|error|warning|xfailed|deselected)"
SUBSTITUTIONS = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "<TIME>"),
    (r"\b[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\bsha256:[0-9a-f]{12,}", "sha256:<HASH>"),
    (r"\b[0-9a-f]{12,}\b", "<HASH>"),
    (r"\b0x[0-9a-fA-F]+\b", "<ADDR>"),
    (r"^\d+\.\d+ (?=\S)", "<DUR> "),
    (r"\b\d+m ?\d+(?:\.\d+)?s\b", "<DUR>"),
    (r"\b\d+(?:\.\d+)?\s?(?:ms|µs|us|ns)\b", "<DUR>"),
    (r"\b\d+(?:\.\d+)?s(?=[\s,)\]]|$)", "<DUR>"),
    (r"\b\d+(?:\.\d+)? seconds?\b", "<DUR>"),
    (r"\b\d+(?:\.\d+)?\s?[KMGT]i?B\b", "<SIZE>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?\b", "<IP>"),
    (r"\b((?:[a-z0-9-]+\.)+[a-z]{2,}|localhost):\d{2,5}\b", "$1:<PORT>"),
    (r"/home/[\w.-]+/work/[\w.-]+/[\w.-]+/", ""),
    (r"/github/workspace/", ""),
    (r"/(?:tmp|var/tmp)/[\w.-]+/", "<TMP>/"),
    (r"/var/folders/[\w./+-]+/", "<TMP>/"),
    (r"[A-Z]:\\Users\\[^\\]+\\", r"~\\"),
    (r"/(?:home|Users)/[\w.-]+/", "~/"),
    (r"(\.[A-Za-z]{1,6}):\d+(?::\d+)?\b", "$1:<LINE>"),
    (r"\b(pid|PID|process|Process|goroutine|worker)\s+\d+\b", "$1 <NUM>"),
    (r"\b\d{9,}\b", "<NUM>"),
)

# What must agree before two failures may be one. Multiline where a line end matters.
DISCRIMINATORS = (
    ("pytest", r"^(?:FAILED|ERROR) (\S+::\S+|\S+\.py)"),
    ("gotest", r"^--- FAIL: (\S+)"),
    ("gopanic", r"^panic: ([^\[]+?)(?:\s*\[recovered\])?$"),
    ("exception", r"\b([A-Z][A-Za-z0-9_]*(?:Error|Exception))\b"),
    ("npmcode", r"^npm (?:ERR!|error) code (\S+)"),
    ("npmpkg", r"No matching version found for (\S+?)\.?$"),
    ("http", r"(?:HTTP status|status code|status|npm ERR!|npm error)\D{0,12}\b([45]\d\d)\b"),
    ("http", r"\b([45]\d\d) (?:Bad Gateway|Service Unavailable|Gateway Time-?out|Not Found)"),
    ("exit", r"exit (?:code|status):? (\d+)"),
    ("signal", r"\bsignal: (\w+)"),
    ("gradle", r"Execution failed for task '([^']+)'"),
    ("maven", r"Failed to execute goal ([\w.:-]+)"),
    ("dockerstep", r'process "([^"]+)" did not complete'),
    ("assertion", r"^E\s+(\w*(?:Error|Exception|assert))"),
)


def normalise_line_sql(line: str) -> str:
    """A line with everything that varies between runs replaced by tokens."""
    apply = lambda text, step: replaced_sql(text, *step)
    once = lambda value, name, use: f"transform(array({value}), {name} -> {use})[0]"
    counted = functools.reduce(apply, COUNT_LINES, line)
    banner = f"CASE WHEN {matches_sql('c', BANNER)} THEN {replaced_sql('c', BANNER_COUNT, '<N> $2')} ELSE c END"
    # most lines hold no digit: of the substitutions only those of paths can touch them
    plain = functools.reduce(apply, [s for s in SUBSTITUTIONS if r"\d" not in s[0] and "0-9" not in s[0]], "b")
    full = functools.reduce(apply, SUBSTITUTIONS, "b")
    out = f"CASE WHEN rlike(b, {quoted('(?U)[0-9]|[0-9a-fA-F]{12}')}) OR rlike(b, {quoted('(?U)' + chr(92) + 'd')}) THEN {full} ELSE {plain} END"
    return trimmed_sql(replaced_sql(once(counted, "c", once(banner, "b", out)), r"[ \t]+", " "))


def normalise_sql(lines: str) -> str:
    """Normalised lines that are not empty, joined by line feeds."""
    return f"array_join(filter(transform({lines}, l -> {normalise_line_sql('l')}), l -> l <> ''), '\\n')"


def discriminators_sql(text: str) -> str:
    """Sorted distinct kind:value tokens of a normalised text."""

    def tokens(kind: str, pattern: str) -> str:
        return f"transform(regexp_extract_all({text}, {quoted('(?mdU)' + pattern)}, 1), v -> concat({quoted(kind + ':')}, {trimmed_sql('v')}))"

    return f"array_sort(array_distinct(flatten(array({', '.join(tokens(k, p) for k, p in DISCRIMINATORS)}))))"


@F.pandas_udf(T.StringType())
def digest(texts):
    """BLAKE2b of 8 bytes in hexadecimal; Spark has no such function."""
    import hashlib

    return texts.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=8).hexdigest())
