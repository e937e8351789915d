import os

from stratalog.plans import report
from stratalog.sources import FileCorpus, samples


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs}


def test_same_seed_same_bytes(tmp_path):
    for name, seed in (("a", 3), ("b", 3), ("c", 4)):
        samples.write(str(tmp_path / name), seed)
    assert files(tmp_path / "a") == files(tmp_path / "b") != files(tmp_path / "c")


def test_every_cause_is_one_cluster(spark, tmp_path):
    runs = samples.write(str(tmp_path))
    found = report.analyse(FileCorpus(str(tmp_path)).runs(spark))
    clusters = {r.rule: r for r in found.clusters.collect()}
    failing = sum(r["conclusion"] != "success" for r in runs)
    assert found.clusters.count() == len(samples.CAUSES) == len(clusters) and found.totals.first().failed_runs == failing
    for cause in samples.CAUSES:
        c = clusters[cause.rule]
        assert (c.verdict, c.occurrences, list(c.jobs)) == (cause.verdict, 4 * cause.history.count("F"), [cause.job]), cause.name
