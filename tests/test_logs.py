import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from stratalog.functions import logtext
from stratalog.functions.rules import RULES
from stratalog.operators import clustering, extraction
from stratalog.plans.tables import BLOCKS, PLANTED

STAMP = "2026-05-14T09:12:03.1234567Z "


def column(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.o for r in rows.select("i", make(F.col("t")).alias("o")).orderBy("i").collect()]


def test_cleaning(spark):
    texts = [f"{STAMP}run\n{STAMP}done", f"{STAMP}at {STAMP}x", "\x1b[31mFAILED\x1b[0m a.py", "10%\r60%\r100%", "a\n\nb\n\n \n", "a\r\nb\t", "", None, "x\u0085\u2028y\u00a0"]
    assert column(spark, texts, logtext.clean_lines) == [["run", "done"], [f"at {STAMP.strip()} x"], ["FAILED a.py"], ["100%"], ["a", "", "b"], ["a", "b"], [], [], ["x\u0085\u2028y"]]


def test_sections(spark):
    text = "##[endgroup]\n##[group]one\nx\n##[endgroup]\ny\n##[group]two\n##[group]three\nz"
    got = column(spark, [text], lambda t: logtext.sections(logtext.clean_lines(t)))[0]
    assert [tuple(s) for s in got] == [("one", 1, 3), ("two", 5, 5), ("three", 6, 7)]
    text = "##[group]  Run \u00a0 tests\u00a0\nx\n##[group]"
    got = column(spark, [text], lambda t: logtext.sections(logtext.clean_lines(t)))[0]
    assert [tuple(s) for s in got] == [("Run \u00a0 tests", 0, 1), ("", 2, 2)]


PAIRS_EQUAL = [
    ("took 1.5s, ok", "took 22s, ok"),
    ("at 2026-01-01 10:00:00 now", "at 2025-11-30T23:59:59.5Z now"),
    ("id 123e4567-e89b-12d3-a456-426614174000", "id 00000000-0000-0000-0000-000000000000"),
    ("File my_x.py:10: in f", "File my_x.py:999:2: in f"),
    ("/home/runner/work/a/a/src/x.py", "/home/ci/work/b/b/src/x.py"),
    ("C:\\Users\\me\\x", "D:\\Users\\you\\x"),
    ("connect 10.0.0.1:5432", "connect 192.168.1.20:80"),
    ("db.example.com:5432 refused", "db.example.com:81 refused"),
    ("=== 3 failed, 10 passed in 2s ===", "=== 4 failed, 11 passed in 9s ==="),
    ("used 12.5 MiB", "used 3GB"),
    ("worker 12 died", "worker   7 died"),
    ("3.411 npm", "99.1 npm"),
]
PAIRS_APART = [("exit code 1", "exit code 2"), ("HTTP status: 502", "HTTP status: 503"), ("left-pad@1.0.2", "left-pad@1.0.3"), ("limit is 45 minutes", "limit is 60 minutes"), ("test_a", "test_b")]


def test_normalisation_pairs(spark):
    norm = lambda texts: column(spark, texts, lambda t: F.expr(logtext.normalise_sql("array(t)")))
    for a, b in zip(*(norm([p[k] for p in PAIRS_EQUAL]) for k in (0, 1)), strict=True):
        assert a == b
    for a, b in zip(*(norm([p[k] for p in PAIRS_APART]) for k in (0, 1)), strict=True):
        assert a != b
    once = norm([p[0] for p in PAIRS_EQUAL + PAIRS_APART])
    assert norm(once) == once
    assert norm(["D:\\Users\\you\\x", "/tmp/abc-1/f", "0xdeadBEEF", "ok  pkg/a 0.42s"]) == ["~\\x", "<TMP>/f", "<ADDR>", "ok pkg/a <DUR>"]


def test_discriminators_and_digest(spark):
    text = "FAILED tests/a.py::test_b[x] - no\npanic: boom [recovered]\nCaused by: java.lang.IOException\nnpm ERR! code E404\nexit code: 3\nE   AssertionError: x"
    assert column(spark, [text], lambda t: F.expr(logtext.discriminators_sql("t")))[0] == sorted(
        ["pytest:tests/a.py::test_b[x]", "gopanic:boom", "exception:IOException", "exception:AssertionError", "npmcode:E404", "exit:3", "assertion:AssertionError"]
    )
    assert column(spark, [""], logtext.digest) == ["e4a6a0577479b2b4"]


def spans(spark, logs, code=None):
    rows = spark.createDataFrame([(i, t, code) for i, t in enumerate(logs)], "i int, log string, exit_code int")
    return [r.span for r in extraction.extract(rows).orderBy("i").collect()]


def brute_best(lines, exit_code=None):
    """The selection rules written as loops over lines."""
    import re

    sections, opened = [], None
    for i, x in enumerate(lines):
        if re.match(r"##\[group\]", x):
            if opened is not None:
                sections.append((opened, i - 1))
            opened = i
        elif re.match(r"##\[endgroup\]\s*$", x) and opened is not None:
            sections.append((opened, i))
            opened = None
    if opened is not None:
        sections.append((opened, len(lines) - 1))
    best = None
    for k, r in enumerate(RULES):
        until = -1
        for a, x in enumerate(lines):
            if a <= until or not re.search(r.anchor, x):
                continue
            lo, hi = next(((s, e) for s, e in sections if s <= a <= e), (0, len(lines) - 1))
            start = max(lo, a - r.before)
            if r.open:
                back = [i for i in range(max(lo, a - r.max_back), a + 1) if re.search(r.open, lines[i])]
                start = back[-1] if back else start
            end = min(hi, a + r.after)
            if r.close:
                ahead = [i for i in range(a + 1, min(hi, a + r.max_forward) + 1) if re.search(r.close, lines[i])]
                if ahead:
                    end = ahead[0] if r.close_inclusive else max(a, ahead[0] - 1)
            until = end
            key = (-r.weight, start, k, a)
            if best is None or key < best[0]:
                best = (key, r.name, start, end)
    return best and best[1:]


def test_extraction_against_loops(spark):
    import random

    rng = random.Random(12)
    vocabulary = [
        "plain text", "", "##[group]step", "##[endgroup]", "##[error]Process completed with exit code 1.", "##[error]bad thing", "npm ERR! code E1",
        "npm ERR! notarget nothing", "FAILURE: Build failed with an exception.", "> Task failed", "* Try:", "--- FAIL: TestX (0.1s)", "=== RUN  TestX", "PASS",
        "FAIL pkg", 'Exception in thread "main" a.b.CError', "\tat a.b(C.java:1)", "Caused by: x", "E    assert 1", "_____ test_x _____", "panic: no",
        "No space left on device", "OOMKilled", "[ERROR] Failures: ", "[ERROR] -> [Help 1]", "=== short test summary info ===", "FAILED a::b", "=== 1 failed in 2s ===",
    ]
    logs = [[rng.choice(vocabulary[: rng.choice([8, 16, 28])]) for _ in range(rng.randint(1, 40))] for _ in range(150)]
    got = spans(spark, ["\n".join([*ls, "end"]) for ls in logs])
    for ls, s in zip(logs, got, strict=True):
        want = brute_best([x.rstrip() for x in [*ls, "end"]])
        assert ((s.rule, s.start_line, s.end_line) == want) if want else s.rule == "unclassified-tail", ls
        assert s.lines == [x.rstrip() for x in [*ls, "end"]][s.start_line : s.end_line + 1]


def test_tail_and_empty_logs(spark):
    a, b, c = spans(spark, ["\n".join(f"line {i}" for i in range(200)), "", "x\n\ny\n"], 3)
    assert (a.rule, a.start_line, a.end_line, len(a.lines)) == ("unclassified-tail", 175, 199, 25) and a.summary.endswith("(exit code 3)")
    assert (b.summary, b.lines) == ("empty log", []) and (c.start_line, c.end_line) == (0, 2)


def test_similarity_and_merging(spark):
    assert clustering.ratio("tide", "diet") == difflib.SequenceMatcher(None, "tide", "diet", autojunk=False).ratio() != clustering.ratio("diet", "tide")
    base = "the quick brown fox jumps over the lazy dog " * 3
    rows = [("d1", base, ["x:1"], "test"), ("d0", base + "!", ["x:1"], "test"), ("d2", base, ["x:2"], "test"), ("d3", base, ["x:1"], "build"), ("d4", "something else", ["x:1"], "test")]
    prints = spark.createDataFrame(rows, "digest string, normalised string, discriminators array<string>, category string")
    got = dict(map(tuple, clustering.merge_similar(prints).collect()))
    assert got == {"d0": "d0", "d1": "d0", "d2": "d2", "d3": "d3", "d4": "d4"}
    assert dict(map(tuple, clustering.merge_similar(prints, max_bucket=2).collect()))["d1"] == "d1"
    assert dict(map(tuple, clustering.merge_similar(prints, threshold=0.0).collect()))["d4"] == "d0"
    assert clustering.merge_similar(prints.limit(0)).count() == 0


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    texts = ["", "x"]
    for _ in range(12):
        base = [rng.choice("abcdé ") for _ in range(rng.choice([8, 30, 80]))]
        for _ in range(5):
            near = list(base)
            for _ in range(rng.randint(0, len(base) // 6)):
                near[rng.randrange(len(near))] = rng.choice("xyz")
            texts.append("".join(near))
    rows = [(f"{i:03d}", t, ["k"] if i % 3 else [], "test") for i, t in enumerate(texts)]
    prints = spark.createDataFrame(rows, "digest string, normalised string, discriminators array<string>, category string")
    want, root = {}, {r[0]: r[0] for r in rows}
    for a in rows:
        for b in rows:
            r = difflib.SequenceMatcher(None, a[1], b[1], autojunk=False).ratio()
            if a[0] < b[0] and a[2] == b[2] and r >= 0.88:
                want[a[0], b[0]] = r
                low, high = sorted((root[a[0]], root[b[0]]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {(r.a, r.b): r.similarity for r in clustering.similar_pairs(prints, max_bucket=None).collect()} == want and want
    assert dict(map(tuple, clustering.merge_similar(prints, max_bucket=None).collect())) == root


def test_hints_are_in_every_match():
    lines = [rule_line for p in PLANTED for rule_line in (p[0], f"x {p[0]} y")] + [x for b in BLOCKS for x in b.split("\n")]
    lines += ["exit code: 137", "npm error code E1", "504 Gateway Timeout", "write /var/lib/docker/x: no space", "The action 'x' has timed out", "step 12 Killed  "]
    for rule in RULES:
        for pattern in (rule.anchor, rule.open, rule.close, rule.summary):
            for line in lines:
                if pattern and re.search(pattern, line) and (found := logtext.hints(pattern)):
                    assert any(h in line for h in found), (pattern, line)
    assert logtext.hints("a|bcd") is None and logtext.hints("^(?:abcd|xyz)e?f") == ("abcd", "xyz")


@pytest.mark.parametrize("seconds,told", [(0, "0s"), (59.4, "59s"), (0.5, "0s"), (1.5, "2s"), (60, "1m"), (150, "2m"), (5399, "90m"), (5400, "1.5h"), (8460, "2.4h"), (8100, "2.2h"), (9900, "2.8h")])
def test_durations(spark, seconds, told):
    from stratalog.functions.runs import format_duration

    assert spark.range(1).select(format_duration(F.lit(float(seconds)))).first()[0] == told


def test_durations_against_python(spark):
    from stratalog.functions.runs import format_duration

    xs = [5400 + 18 * k for k in range(3000)]
    got = column(spark, list(map(str, xs)), lambda t: format_duration(t.cast("double")))
    assert got == [f"{x / 60:.0f}m" if x / 60 < 90 else f"{x / 3600:.1f}h" for x in xs]
