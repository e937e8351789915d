import random

from stratalog.llm.common import connected_components


def smallest_reachable(edges):
    root = {}

    def find(n):
        root.setdefault(n, n)
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in root}


def test_few_edges_are_joined_at_once_and_as_in_rounds(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(-(1 << 62), 1 << 62), rng.randrange(5)) for _ in range(50)]  # hubs
    edges += [(k, k + 7) for k in rng.sample(range(100, 600), 400)]  # paths in any order
    edges += [(rng.randrange(10**6, 10**6 + 300), rng.randrange(10**6, 10**6 + 300)) for _ in range(150)]
    want = smallest_reachable([e for e in edges if e[0] != e[1]])
    frame = spark.createDataFrame([*edges, (None, 1), (2, None), (9_999, 9_999)], "a long, b long")
    tracker = spark.sparkContext.statusTracker()
    tasks = {}
    for at_once in (0, len(edges)):
        spark.sparkContext.setJobGroup(f"components-{at_once}", "")
        rows = connected_components(frame, at_once=at_once).collect()
        assert len(rows) == len(want) and {r.node: r.component for r in rows} == want
        stages = {s for job in tracker.getJobIdsForGroup(f"components-{at_once}") for s in tracker.getJobInfo(job).stageIds}
        tasks[at_once] = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # each task leaves files and messages: in rounds, over many partitions, those of few edges filled the disk
    assert 0 < 4 * tasks[len(edges)] < tasks[0], tasks
    assert connected_components(frame.where("a > b and a < b")).collect() == []


def test_edges_between_strings_go_in_rounds(spark):
    frame = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
