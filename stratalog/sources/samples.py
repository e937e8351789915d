"""A corpus of made-up failures: twelve causes, each with its own log and history, written from a seed.

The same seed writes the same bytes. Every occurrence of a cause differs in what changes between runs (times,
durations, hashes, addresses, numbers of lines), so a corpus tells whether causes are found again.
"""

from __future__ import annotations

import os
import random
from datetime import UTC, datetime, timedelta
from typing import NamedTuple

from stratalog.sources.manifest import write_manifest


class Cause(NamedTuple):
    name: str
    rule: str
    job: str
    runner: str
    #: The attempts on one commit: F fails, P passes.
    history: str
    #: Lines of the failure; {d} a duration, {h} a hash, {n} a number, {ip} an address.
    lines: tuple[str, ...]

    @property
    def verdict(self) -> str:
        return "flaky" if "P" in self.history else "deterministic" if self.history.count("F") > 1 else "unproven"


CAUSES = (
    Cause("wrong-total", "pytest-summary", "unit", "ubuntu-24.04", "FF", ("E   AssertionError: assert 40 == 41", "=== short test summary info ===", "FAILED tests/test_cart.py::test_total - assert 40 == 41", "=== 1 failed, {n} passed in {d} ===")),
    Cause("lost-lock", "go-test-panic", "race", "ubuntu-24.04", "FP", ("panic: close of nil channel", "goroutine {n} [running]:", "main.release(0x{h})", "FAIL\texample.org/lock\t{d}")),
    Cause("slow-clock", "go-test-fail", "go", "ubuntu-24.04", "FP", ("=== RUN   TestClock", "    clock.go:41: waited {d} for a tick", "--- FAIL: TestClock ({d})", "=== RUN   TestOther", "--- PASS: TestOther ({d})")),
    Cause("gone-package", "npm-error", "web", "ubuntu-24.04", "FF", ("npm ERR! code ETARGET", "npm ERR! notarget No matching version found for tiny-router@9.9.9.", "npm ERR! A complete log of this run can be found in: /home/ci/{h}.log")),
    Cause("mirror-down", "registry-unavailable", "image", "ubuntu-24.04", "FP", ("#{n} ERROR: received unexpected HTTP status: 503 Service Unavailable", "while reading from {ip}")),
    Cause("bad-step", "docker-build", "image", "ubuntu-24.04", "FF", (" > [build 3/7] RUN make all:", "0.{n} cc: error: no input files", "ERROR: failed to solve: process \"/bin/sh -c make all\" did not complete successfully: exit code: 2")),
    Cause("eaten-memory", "oom-kill", "load", "linux-large", "F", ("worker {n} grew to {n} MiB", "Out of memory: Killed process {n} (loader)", "loader exited with code 137")),
    Cause("hung-page", "runner-timeout", "browser", "macos-15", "FP", ("waiting for the page", "##[error]The action 'browse' has timed out after 30 minutes.")),
    Cause("full-disk", "disk-full", "pack", "windows-2025", "F", ("writing layer {h}", "tar: write error: No space left on device")),
    Cause("missing-symbol", "maven-goal", "java", "ubuntu-24.04", "FFF", ("[INFO] compiled in {d}", "[ERROR] Failed to execute goal org.example:compiler:3.1:compile: cannot find symbol Ledger", "[ERROR] -> [Help 1]")),
    Cause("stale-schema", "gradle-failure", "jvm", "ubuntu-24.04", "FF", ("FAILURE: Build failed with an exception.", "* What went wrong:", "Execution failed for task ':store:migrate'.", "> schema is older than 7", "* Try:", "> Run with --info")),
    Cause("null-route", "java-exception", "router", "ubuntu-24.04", "F", ('Exception in thread "main" java.lang.NullPointerException: route', "\tat org.example.Router.pick(Router.java:{n})", "\tat org.example.Main.main(Main.java:{n})", "stopped")),
)

START = datetime(2026, 3, 2, 8, 0, tzinfo=UTC)


def _log(cause: Cause, rng: random.Random) -> str:
    at = START + timedelta(seconds=rng.randrange(10**6))
    out = ["##[group]Set up", f"image {rng.getrandbits(64):016x}", "##[endgroup]", f"##[group]Run {cause.job}"]
    out += [f"unit {rng.randrange(10**9, 10**10)} done in {rng.randrange(1, 900) / 10}s" for _ in range(rng.randrange(20, 60))]
    for line in cause.lines:
        out.append(
            line.replace("{d}", f"{rng.randrange(1, 900) / 10}s").replace("{h}", f"{rng.getrandbits(64):016x}")
            .replace("{n}", str(rng.randrange(10**9, 10**10))).replace("{ip}", f"10.{rng.randrange(256)}.{rng.randrange(256)}.7:443")
        )
    out += ["##[endgroup]", "##[error]Process completed with exit code 1.", "Post: removing files"]
    stamp = lambda i: (at + timedelta(milliseconds=217 * i)).strftime("%Y-%m-%dT%H:%M:%S.%f0Z ")
    return "".join(f"{stamp(i)}{line}\n" for i, line in enumerate(out))


def write(root: str, seed: int = 11, occurrences: int = 4, passing: int = 40) -> list[dict]:
    """Write the corpus below ``root``: every cause on so many commits, and runs that pass; returns the manifest's runs."""
    rng, runs = random.Random(seed), []
    os.makedirs(os.path.join(root, "logs"), exist_ok=True)

    def add(job: str, runner: str, commit: str, run_id: int, attempt: int, conclusion: str, **more) -> None:
        began = START + timedelta(minutes=rng.randrange(60 * 24 * 14))
        runs.append({
            "run_id": str(run_id), "attempt": attempt, "workflow": "ci.yml", "job": job, "branch": f"topic-{run_id % 7}", "commit": commit,
            "actor": f"dev{run_id % 5}", "conclusion": conclusion, "started_at": began.isoformat(), "runner": runner,
            "completed_at": (began + timedelta(seconds=rng.randrange(30, 3000))).isoformat(), **more,
        })

    run_id = 1000
    for cause in CAUSES:
        for _ in range(occurrences):
            run_id, commit = run_id + 1, f"{rng.getrandbits(160):040x}"
            for attempt, outcome in enumerate(cause.history, 1):
                if outcome == "P":
                    add(cause.job, cause.runner, commit, run_id, attempt, "success")
                    continue
                path = f"logs/{cause.name}-{run_id}-{attempt}.log"
                with open(os.path.join(root, path), "w", encoding="utf-8", newline="\n") as f:
                    f.write(_log(cause, rng))
                add(cause.job, cause.runner, commit, run_id, attempt, "failure", log=path, exit_code=1)
    for _ in range(passing):
        run_id += 1
        add("unit", "ubuntu-24.04", f"{rng.getrandbits(160):040x}", run_id, 1, "success")
    write_manifest(root, "example/shop", runs)
    return runs
