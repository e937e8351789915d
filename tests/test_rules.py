"""One log for each rule: which rule explains it, the first and last line of its span, and how its summary begins."""

import pytest
from test_logs import brute_best, spans

from stratalog.functions.rules import RULES

PAD = [f"preparing part {i}" for i in range(12)]
TAIL = ["cleaning up", "done"]

LOGS = {
    "oom-kill": ([*PAD, "Out of memory: Killed process 77 (sorter)", *TAIL], 6, 14, "Out of memory: Killed process 77"),
    "disk-full": ([*PAD, "cp: error writing 'x': No space left on device", *TAIL], 8, 14, "cp: error writing"),
    "registry-unavailable": ([*PAD, "error pulling: 503 Service Unavailable", *TAIL], 8, 14, "error pulling: 503"),
    "runner-timeout": ([*PAD, "##[error]The operation was canceled.", *TAIL], 4, 14, "##[error]The operation was canceled."),
    "docker-build": (
        [*PAD, " > [app 2/5] RUN pip install .:", "0.3 collecting", "0.9 no such file", "ERROR: failed to solve: process failed", *TAIL],
        12, 15, "ERROR: failed to solve: process failed",
    ),
    "go-test-panic": ([*PAD, "panic: index out of range", "goroutine 7 [running]:", "main.f()", "FAIL\texample.org/f\t0.1s", *TAIL], 9, 15, "panic: index out of range"),
    "maven-test": (
        [*PAD, "[ERROR] Tests run: 9, Failures: 1, Errors: 0, Skipped: 0", "[ERROR]   org.example.SumTest -- expected 4", "[INFO] ------------", *TAIL],
        11, 14, "[ERROR]   org.example.SumTest -- expected 4",
    ),
    "npm-error": (
        [*PAD, "npm ERR! code ERESOLVE", "npm ERR! could not resolve", "npm ERR! A complete log of this run can be found in: x", *TAIL],
        12, 14, "npm ERR! could not resolve",
    ),
    "gradle-failure": (
        [*PAD, "FAILURE: Build failed with an exception.", "* What went wrong:", "Execution failed for task ':a:test'.", "> tests failed", "* Try:", "> Run it", *TAIL],
        12, 16, "Execution failed for task ':a:test'.",
    ),
    "maven-goal": ([*PAD, "[ERROR] Failed to execute goal a:b:1:compile", "[ERROR] -> [Help 1]", *TAIL], 12, 13, "[ERROR] Failed to execute goal a:b:1:compile"),
    "pytest-summary": (
        [*PAD, "=== short test summary info ===", "FAILED tests/test_a.py::test_b - assert 0", "=== 1 failed, 3 passed in 2s ===", *TAIL],
        12, 14, "FAILED tests/test_a.py::test_b",
    ),
    "go-test-fail": ([*PAD, "=== RUN   TestSum", "    sum.go:9: got 3", "--- FAIL: TestSum (0.0s)", "=== RUN   TestTwo", *TAIL], 12, 14, "--- FAIL: TestSum (0.0s)"),
    "java-exception": (
        [*PAD, 'Exception in thread "main" java.lang.IllegalStateException: no', "\tat a.B.c(B.java:3)", "Caused by: java.io.IOException: x", "\t... 2 more", "finished", *TAIL],
        12, 15, 'Exception in thread "main"',
    ),
    "pytest-traceback": ([*PAD, "_____ test_sum _____", "def test_sum():", ">   assert 1 == 2", "E   assert 1 == 2", "tests/a.py:3: AssertionError", *TAIL], 12, 17, "E   assert 1 == 2"),
    "annotation-error": ([*PAD, "##[error]Licence check found a problem", *TAIL], 4, 14, "##[error]Licence check"),
    "exit-code": ([*PAD, "##[error]Process completed with exit code 3.", *TAIL], 0, 12, "##[error]Process completed with exit code 3."),
}


def test_every_rule_has_a_log():
    assert set(LOGS) == {r.name for r in RULES}


def test_spans_of_all_rules(spark):
    found = spans(spark, ["\n".join(lines) for lines, *_ in LOGS.values()])
    for (rule, (lines, first, last, summary)), s in zip(LOGS.items(), found, strict=True):
        assert (s.rule, s.start_line, s.end_line) == (rule, first, last) == brute_best(lines), rule
        assert s.summary.startswith(summary) and s.lines == lines[first : last + 1], rule
        assert (s.category, s.weight) == next((r.category, r.weight) for r in RULES if r.name == rule)


@pytest.mark.parametrize("stamped", [False, True])
def test_spans_stay_in_their_section(spark, stamped):
    lines = ["before", "##[group]build", "a", "ENOSPC", "##[endgroup]", "after", "more"]
    text = "\n".join(f"2026-01-02T03:04:05.6Z \x1b[31m{x}\x1b[0m" if stamped else x for x in lines)
    (s,) = spans(spark, [text])
    assert (s.rule, s.start_line, s.end_line, s.lines) == ("disk-full", 1, 4, lines[1:5])


def test_weights_and_places_decide(spark):
    two = ["npm ERR! code A", "x", "npm ERR! A complete log of this run can be found in: y", "FAILURE: Build failed with an exception.", "* Try:"]
    both = [*PAD, "--- FAIL: TestX (0.1s)", "PASS", "Out of memory: Killed process 1", "end"]
    a, b = spans(spark, ["\n".join(two), "\n".join(both)])
    assert (a.rule, a.start_line) == ("npm-error", 0) and b.rule == "oom-kill"
