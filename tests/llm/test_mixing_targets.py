from stratalog.llm import mixing


def lags(spark, counts, weights=None, resolution=mixing.RESOLUTION):
    """The largest distance of any source from its rounded and its target share, while no source has run out."""
    sizes = spark.createDataFrame(list(counts.items()), "source string, n long")
    shared = mixing.shares(sizes, weights, resolution)
    row = shared.first()
    assert sum(row.a) == row.q and min(row.a) >= 1
    given = {s: weights[s] if weights else n**0.5 for s, n in counts.items()}
    target = [given[s] / sum(given.values()) for s in row.names]
    blocks, had, worst = [-(-counts[s] // 16) for s in row.names], [0] * len(row.a), [0.0, 0.0]
    order = sorted((r.at, row.names.index(r.source)) for r in mixing.period(shared).collect())
    assert [t for t, _ in order] == list(range(row.q)) and row.q >= sum(blocks)
    for t, s in order[: sum(blocks)]:
        had[s] += 1
        for k, share in enumerate((target, [a / row.q for a in row.a])):
            worst[k] = max(worst[k], *(abs((t + 1) * w - n) for w, n in zip(share, had, strict=True)))
    return row, target, worst


def test_shares_are_the_target_weights_rounded(spark):
    counts = {f"s{i:02d}": 1600 for i in range(49)} | {"big": 40_000}
    row, target, (to_target, to_share) = lags(spark, counts, {s: 0.5 if s == "big" else 0.5 / 49 for s in counts})
    assert row.a[row.names.index("big")] == row.q // 2  # was about 0.476 of the slots
    assert all(abs(a - w * row.q) < 1 for a, w in zip(row.a, target, strict=True))
    assert to_share < 1 and to_target < 2


def test_long_runs_grow_the_period_and_tiny_weights_keep_a_slot(spark):
    counts = {f"s{i:02d}": 600 for i in range(19)} | {"big": 60_000}
    row, target, (to_target, to_share) = lags(spark, counts)
    assert row.q > 4000 and to_share < 1 and to_target < 2
    tiny, _, _ = lags(spark, {"a": 10, "b": 10, "c": 10}, {"a": 1.0, "b": 1e-9, "c": 1e-9}, 20)
    assert tiny.a == [18, 1, 1]
