"""The rule table: what marks the cause of a failure in a build log, as data."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    category: str
    weight: int
    anchor: str
    before: int = 4
    after: int = 20
    open: str | None = None
    close: str | None = None
    close_inclusive: bool = True
    max_back: int = 200
    max_forward: int = 400
    summary: str | None = None


# Names, weights, extents and patterns decide which lines are a failure's cause.
RULES = (
    Rule(
        "oom-kill", "resource", 100,
        r"Out of memory: Killed process|OOMKilled|\b\d+ Killed\s{2,}|signal: killed"
        r"|\b(?:exit code|exit status|exited with code|returned a non-zero code):? ?137\b",
        before=6, after=5, summary=r"Out of memory|OOMKilled|Killed|signal: killed|137",
    ),
    Rule("disk-full", "resource", 92, r"No space left on device|ENOSPC|write /var/lib/docker.*: no space", before=4, after=4),
    Rule(
        "registry-unavailable", "infrastructure", 90,
        r"received unexpected HTTP status: 5\d\d|failed to (?:fetch|pull|copy|resolve source metadata).*\b(?:429|5\d\d)\b"
        r"|npm ERR! (?:429|5\d\d) \b|net/http: TLS handshake timeout|Could not resolve host|Temporary failure in name resolution"
        r"|EAI_AGAIN|\b(?:502 Bad Gateway|503 Service Unavailable|504 Gateway Time-?out)\b",
        before=4, after=12, summary=r"5\d\d|429|TLS handshake|resolve host|EAI_AGAIN",
    ),
    Rule(
        "runner-timeout", "timeout", 86,
        r"has exceeded the maximum execution time|##\[error\]The operation was canceled\.|The action '[^']+' has timed out"
        r"|context deadline exceeded|Timeout has been reached",
        before=8, after=4,
    ),
    Rule(
        "docker-build", "build", 70,
        r"^ERROR: failed to solve: |^The command '/bin/sh -c .*' returned a non-zero code: \d+",
        before=30, after=0, open=r"^\s*>\s*\[[^\]]+\]|^Step \d+/\d+ : ", max_back=150,
        summary=r"^ERROR: failed to solve|returned a non-zero code",
    ),
    Rule("go-test-panic", "test", 68, r"^panic: ", before=3, after=40, close=r"^FAIL\b", max_forward=200, summary=r"^panic: "),
    Rule(
        "maven-test", "test", 66, r"^\[ERROR\] Tests run: \d+, Failures: [1-9]|^\[ERROR\] Failures: $",
        before=1, after=20, close=r"^\[INFO\] -{10,}|^\[ERROR\] -> \[Help", summary=r"^\[ERROR\]\s+\S+\.\S+ -- ",
    ),
    Rule(
        "npm-error", "dependency", 64, r"^npm ERR! code |^npm error code ", before=0, after=25,
        close=r"^npm (?:ERR!|error) A complete log of this run can be found",
        summary=r"^npm (?:ERR!|error) (?!code\b|A complete log)\S",
    ),
    Rule(
        "gradle-failure", "build", 64, r"^FAILURE: Build (?:failed|completed) with .* exception",
        before=0, after=30, close=r"^\* Try:", summary=r"^> |^Execution failed for task ",
    ),
    Rule(
        "maven-goal", "build", 63, r"^\[ERROR\] Failed to execute goal ",
        before=0, after=15, close=r"^\[ERROR\] -> \[Help", summary=r"^\[ERROR\] Failed to execute goal ",
    ),
    Rule(
        "pytest-summary", "test", 62, r"^=+ short test summary info =+$",
        before=0, after=60, close=r"^=+ .*\b\d+ (?:failed|error)", max_forward=300, summary=r"^(?:FAILED|ERROR) ",
    ),
    Rule(
        "go-test-fail", "test", 60, r"^--- FAIL: ", before=8, after=20, open=r"^=== RUN\s",
        close=r"^(?:=== RUN|--- PASS|PASS$|FAIL\b|ok\s)", close_inclusive=False, max_back=60, summary=r"^--- FAIL: ",
    ),
    Rule(
        "java-exception", "build", 58, r'^Exception in thread "[^"]+" [\w.$]+(?:Exception|Error)\b', before=0, after=30,
        close=r"^(?!\s*(?:at |\.\.\.|Caused by:|Suppressed:))\S", close_inclusive=False,
        summary=r"^Exception in thread|^Caused by: ",
    ),
    Rule("pytest-traceback", "test", 56, r"^E\s{3,}\S", before=15, after=2, open=r"^_{5,} .* _{5,}$", max_back=120, summary=r"^E\s{3}\S"),
    Rule(
        "annotation-error", "unknown", 34, r"^##\[error\](?!Process completed with exit code)\S",
        before=8, after=2, summary=r"^##\[error\]",
    ),
    Rule(
        "exit-code", "unknown", 10, r"^(?:##\[error\])?Process completed with exit code [1-9]\d*\.",
        before=20, after=0, summary=r"Process completed with exit code",
    ),
)

TAIL_RULE, TAIL_LINES = "unclassified-tail", 25
