import io
import json
import zipfile
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalog import cli
from stratalog.operators import cost, evidence
from stratalog.plans import render, report
from stratalog.sources import api, manifest
from stratalog.streaming.ingest import cost_per_window

START = datetime(2026, 5, 14, 9, 0, tzinfo=UTC)
TEST_LOG = "=== short test summary info ===\nFAILED tests/test_a.py::test_x - assert 1\n=== 1 failed in 2.1s ===\n"
NPM_LOG = "npm ERR! code E503\nnpm ERR! 503 Service Unavailable <script>\n"


def run(run_id, attempt, job, conclusion, minutes, at, runner="ubuntu-22.04", commit="c0ffee0123", actor="ann", **more):
    return {
        "run_id": run_id, "attempt": attempt, "workflow": "ci.yml", "job": job, "branch": "main", "commit": commit, "actor": actor, "conclusion": conclusion,
        "started_at": (START + timedelta(minutes=at)).isoformat(), "completed_at": (START + timedelta(minutes=at + minutes)).isoformat(), "runner": runner, **more,
    }


HISTORY = [
    run("100", 1, "unit", "failure", 6, 0, log="logs/a.log", exit_code=1),
    run("100", 2, "unit", "failure", 6, 10, log="logs/a.log"),
    *[run(str(r), 1, "web", "failure", 4, r, commit=f"web{r}", actor=f"p{r}", log="logs/all.zip") for r in (200, 201, 202)],
    *[run(str(r), 2, "web", "success", 4, r + 20, commit=f"web{r}", log="logs/gone.log") for r in (200, 201, 202)],
    run("300", 1, "ui", "timed_out", 45, 400, "macOS-14", commit="mac"),
    run("400", 1, "unit", "neutral", 6, 500, commit="fine"),
]


def corpus(tmp_path, runs=HISTORY, **files):
    (tmp_path / "logs").mkdir(parents=True, exist_ok=True)
    (tmp_path / "logs" / "a.log").write_bytes(b"10%\r" + TEST_LOG.encode() + b"\xff\n")
    with zipfile.ZipFile(tmp_path / "logs" / "all.zip", "w") as z:
        z.writestr("0_other.txt", "other")
        z.writestr("1_WEB!.txt", NPM_LOG)
        z.writestr("web/1_Set up.txt", "skipped")
    manifest.write_manifest(str(tmp_path), "octo/repo", runs)
    return str(tmp_path)


def test_history_by_hand(spark, tmp_path):
    found = report.analyse(manifest.read_corpus(spark, corpus(tmp_path)))
    rows = {r.rule: r for r in found.clusters.collect()}
    assert set(rows) == {"pytest-summary", "registry-unavailable", "unclassified-tail"}
    assert [rows[k].verdict for k in ("pytest-summary", "registry-unavailable", "unclassified-tail")] == ["deterministic", "flaky", "unproven"]
    t = found.totals.first()
    assert (t.runs, t.failed_runs, t.clusters, t.wall_micros, t.billable_micros) == (10, 6, 3, 4140 * 10**6, 28440 * 10**6)
    assert rows["registry-unavailable"].people_blocked == 3 and rows["registry-unavailable"].example.lines[0].startswith("npm")
    proofs = {(r.run_id, r.attempt): (r.verdict, list(r.proof)) for r in report.proven(found).collect()}
    assert proofs["100", 1] == ("deterministic", ["100#2"]) and proofs["200", 1] == ("flaky", ["200#2"]) and proofs["300", 1] == ("unproven", [])


def test_renderers(spark, tmp_path):
    found = report.analyse(manifest.read_corpus(spark, corpus(tmp_path)))
    text = render.as_text(found, top=3, spans=True)
    assert text.isascii() and "reproducible" in text and ": FAILED tests/test_a.py::test_x" in text.split("LOG EXCERPTS")[1]
    told = render.as_json(found)
    made = json.loads(told)
    assert told == json.dumps(made, indent=2) + "\n"
    assert [m["run_id"] for m in made["clusters"][1]["occurrences_detail"]] == ["200", "201", "202"] or [m["run_id"] for m in made["clusters"][2]["occurrences_detail"]] == ["200", "201", "202"]
    assert made["totals"]["failed_runs"] == 6 and sum(c["occurrences"] for c in made["clusters"]) == 6
    assert [c["wasted_billable_seconds"] for c in made["clusters"]] == [27000.0, 720.0, 720.0]
    assert made["clusters"][1]["id"] < made["clusters"][2]["id"]
    page = render.as_html(found)
    assert "<script" not in page and "&lt;script&gt;" in page and "http" not in page
    none = report.analyse(manifest.read_corpus(spark, corpus(tmp_path / "b", [HISTORY[-1]])))
    assert "none failed" in render.as_text(none) and "none failed" in render.as_html(none) and json.loads(render.as_json(none))["clusters"] == []


def test_command_line(spark, tmp_path, capsys):
    root = corpus(tmp_path)
    assert cli.main(["report", root, "--json", str(tmp_path / "o.json"), "--html", str(tmp_path / "o.html")], spark) == 0
    assert "COSTLIEST CAUSES" in capsys.readouterr().out and (tmp_path / "o.html").exists()
    assert cli.main(["explain", root, "100", "--attempt", "2"], spark) == 0
    assert "pytest:tests/test_a.py::test_x" in capsys.readouterr().out
    assert cli.main(["explain", root, "999"], spark) == 2
    assert cli.main(["report", str(tmp_path / "nowhere")], spark) == 3
    with pytest.raises(SystemExit) as stop:
        cli.main(["report"], spark)
    assert stop.value.code == 2


@pytest.mark.parametrize(
    "change,told",
    [
        ({"conclusion": None}, "still in progress"),
        ({"conclusion": "odd"}, "unknown conclusion"),
        ({"started_at": "yesterday"}, "900 has an unparsable started_at"),
        ({"log": "logs/missing.log"}, "logs/missing.log"),
    ],
)
def test_ingest_errors(spark, tmp_path, change, told):
    with pytest.raises(manifest.IngestError, match=told):
        manifest.read_corpus(spark, corpus(tmp_path, [{**run("900", 1, "unit", "failure", 1, 0), **change}]))


def test_manifest_errors_and_defaults(spark, tmp_path):
    for text, told in (("[]", "not an object"), ('{"schema": 99, "runs": []}', "unsupported corpus schema"), ('{"schema": 1}', "no list")):
        with pytest.raises(manifest.IngestError, match=told):
            manifest.entries(text)
    with pytest.raises(manifest.IngestError, match="runner"):
        manifest._row(0, {k: "x" for k in manifest.REQUIRED if k != "runner"})
    assert manifest.entries('{"schema": 1, "defaults": {"a": 1, "b": 2}, "runs": [{"b": null}]}') == [{"a": 1, "b": None}]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("job/1_step.txt", "x")
    with pytest.raises(manifest.IngestError, match="no top-level"):
        manifest.read_archive(data.getvalue())
    with pytest.raises(Exception, match="it has: WEB!, other"):
        manifest.read_corpus(spark, corpus(tmp_path, [{**HISTORY[2], "job": "absent"}])).collect()


def test_archives_keep_the_order_of_their_members(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in (("2_Web!.txt", "first"), ("1_WEB?.txt", "second"), ("a/0_x.txt", "step"), ("3_Web!.txt", "first again")):
            z.writestr(name, text)
    assert manifest.read_archive(data.getvalue()) == [(0, "Web!", "first again"), (1, "WEB?", "second")]
    root = corpus(tmp_path, [{**HISTORY[2], "job": "web"}])
    (tmp_path / "logs" / "all.zip").write_bytes(data.getvalue())
    assert manifest.read_corpus(spark, root).first().log == "first again"


def test_every_source_gives_the_same_runs(spark, tmp_path):
    from stratalog.sources import FileCorpus, Recordings, RunTable

    runs = FileCorpus(corpus(tmp_path / "c")).runs(spark)
    runs.drop("log").write.parquet(str(tmp_path / "runs"))
    runs.where("log <> ''").select("ord", "log").write.parquet(str(tmp_path / "logs"))
    table = RunTable(str(tmp_path / "runs"), str(tmp_path / "logs")).runs(spark)
    assert table.dtypes == runs.dtypes and sorted(map(str, table.collect())) == sorted(map(str, runs.collect()))
    payload = {"id": 200, "name": "CI", "head_sha": "abc", "event": "push", "actor": {"login": "ann"}, "repository": {"full_name": "o/r"}}
    job = {"conclusion": "failure", "started_at": "2026-05-14T09:00:00Z", "completed_at": "2026-05-14T09:06:00Z", "runner_name": "r", "steps": []}
    jobs = [{**job, "name": "web"}, {**job, "name": "fine", "conclusion": "success"}]
    (tmp_path / "api.json").write_text(json.dumps({"payload": json.dumps(payload), "jobs": json.dumps(jobs), "archive": "logs/all.zip"}) + "\n")
    got = {r.job: r for r in Recordings(str(tmp_path / "api.json"), str(tmp_path / "c")).runs(spark).collect()}
    assert got["web"].log.startswith("npm ERR! code E503") and got["fine"].log == "" and got["web"].run_id == "200"


def test_since_keeps_recent_runs_of_any_outcome(spark, tmp_path):
    runs = manifest.read_corpus(spark, corpus(tmp_path))
    assert manifest.since(runs, 1, START + timedelta(days=1, minutes=300)).count() == 2
    assert manifest.since(runs, 1, START + timedelta(days=9)).count() == 0


def test_evidence_details(spark):
    rows = [
        (0, "1", 1, "a", "failure", 0), (1, "1", 1, "a", "success", 5), (2, "2", 1, "a", "success", 3), (3, "2", 2, "a", "success", 4),
        (4, "3", 1, "b", "failure", 0), (5, "3", 1, "b", "success", 1), (6, "4", 1, "c", "failure", 0), (7, "5", 1, "c", "cancelled", 1),
    ]
    runs = spark.createDataFrame([(*r[:3], "r", "w", r[3], "c0ffee0123", r[4], START + timedelta(minutes=r[5])) for r in rows], "ord long, run_id string, attempt int, repo string, workflow string, job string, commit string, conclusion string, started_at timestamp")
    bad = runs.where("conclusion <> 'success'")
    got = {r.ord: r for r in evidence.with_proof(evidence.classify(bad, runs), runs).collect()}
    assert list(got[0].proof) == ["2#2"] and got[0].reason == "another run of a on c0ffee01 passed unchanged"
    assert got[6].reason == "c failed again on c0ffee01 without a change" and got[4].reason.startswith("c0ffee01 was never re-run")
    listed = {(r.ord, r.peer): r.passed for r in evidence.peers(bad, runs).collect()}
    assert listed == {(0, "2#1"): True, (0, "2#2"): True, (6, "5#1"): False, (7, "4#1"): False}
    assert got[4].verdict == "unproven" and got[6].verdict == got[7].verdict == "deterministic" and list(got[6].proof) == ["5#1"]


def test_null_parts_of_a_commit_meet_their_peers(spark):
    rows = [(0, "1", 1, None, "failure"), (1, "2", 1, None, "success"), (2, "3", 1, "x", "failure"), (3, "4", None, "x", "failure"), (4, "4", None, "x", "failure")]
    runs = spark.createDataFrame([(o, i, a, "r", None, "j", c, k, START) for o, i, a, c, k in rows], "ord long, run_id string, attempt int, repo string, workflow string, job string, commit string, conclusion string, started_at timestamp")
    judged = evidence.classify(runs.where("conclusion <> 'success'"), runs)
    assert {r.ord: r.verdict for r in judged.collect()} == {0: "flaky", 2: "deterministic", 3: "deterministic", 4: "deterministic"}


def test_multiplier_and_negative_duration(spark):
    rows = [("macOS-14", 10), ("WINDOWS-2022", 2), ("ubuntu-22.04", 1), ("self-hosted", 1)]
    runs = spark.createDataFrame([(r, START, START + timedelta(seconds=k * 2 - 3)) for k, (r, _) in enumerate(rows)], "runner string, started_at timestamp, completed_at timestamp")
    got = cost.priced(runs).collect()
    assert [r.wall_micros for r in got] == [0, 0, 10**6, 3 * 10**6] and got[3].billable_micros == 3 * 10**6


def test_api_payloads(spark):
    payload = {"id": 7, "name": "CI", "path": ".github/workflows/ci.yml", "head_branch": None, "head_sha": "abc", "event": "push", "actor": {"login": "ann"}, "repository": {"full_name": "o/r"}}
    jobs = [
        {"name": "unit", "conclusion": "failure", "started_at": "2026-05-14T09:00:00Z", "completed_at": "2026-05-14T09:06:00Z", "labels": ["ubuntu-22.04"], "runner_name": "", "steps": [{"name": "t", "conclusion": "failure", "number": 1}]},
        {"name": "lint", "conclusion": "skipped", "started_at": "2026-05-14T09:00:00", "completed_at": "2026-05-14T09:00:00+02:00", "labels": [], "steps": []},
    ]
    frame = spark.createDataFrame([(json.dumps(payload), json.dumps(jobs))], "payload string, jobs string")
    a, b = api.jobs(api.workflow_runs(frame)).orderBy(F.desc("job")).collect()
    assert (a.run_id, a.attempt, a.workflow, a.branch, a.runner, a.exit_code, a.conclusion) == ("7", 1, ".github/workflows/ci.yml", "", "ubuntu-22.04", 1, "failure")
    assert (b.runner, b.exit_code, b.conclusion) == ("unknown", None, "success") and (b.started_at - b.completed_at).total_seconds() == 7200
    bad = spark.createDataFrame([("yesterday",)], "t string").select(api.parse_timestamp(F.col("t")))
    with pytest.raises(Exception, match="not a timestamp"):
        bad.collect()


def test_streaming_cost(spark, tmp_path):
    rows = [("unit", "failure", "ubuntu", START, START + timedelta(minutes=2)), ("unit", "success", "ubuntu", START, START), ("unit", "timed_out", "macos", START, START + timedelta(minutes=1))]
    schema = "job string, conclusion string, runner string, started_at timestamp, completed_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = cost_per_window(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("costs").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM costs").collect()
    assert [(r.job, r.occurrences, r.billable_micros) for r in got] == [("unit", 2, 720 * 10**6)]
