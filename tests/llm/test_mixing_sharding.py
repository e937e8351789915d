import math
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm import mixing, sharding

DOC = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()), ("slot", T.StringType()))])


def edf(a):
    """Earliest deadline first, slot by slot, over one period."""
    q, done, out = sum(a), [0] * len(a), []
    for t in range(q):
        ready = [s for s in range(len(a)) if done[s] * q // a[s] <= t]
        s = min(ready, key=lambda s: (-(-(done[s] + 1) * q // a[s]), -a[s], s))
        assert t < -(-(done[s] + 1) * q // a[s])
        out.append(s)
        done[s] += 1
    assert done == list(a)
    return out


def documents(spark, counts):
    rows = [(100 * k + i, f"text {k} {i}", s, "clash") for k, (s, n) in enumerate(counts.items()) for i in range(n)]
    return spark.createDataFrame(rows, DOC)


def test_period_is_the_edf_schedule_and_deviates_by_less_than_a_block(spark):
    sizes = spark.createDataFrame([("a", 700), ("b", 90), (None, 30), ("d", 1)], "source string, n long")
    shared = mixing.shares(sizes, {"a": 0.61, "b": 0.2, "d": 0.07}, 97)
    row = shared.first()
    assert row.q == 97 and sum(row.a) == 97 and row.names == [None, "a", "b", "d"]
    got = sorted((r.at, row.names.index(r.source)) for r in mixing.period(shared).collect())
    assert [s for _, s in got] == edf(row.a)
    had = [0] * 4
    for t, s in got:
        had[s] += 1
        assert all(abs(Fraction((t + 1) * a, 97) - n) < 1 for a, n in zip(row.a, had, strict=True))


def test_every_row_is_placed_once_between_release_and_deadline(spark):
    docs = documents(spark, {"big": 95, "mid": 40, "": 3, None: 7}).unionByName(documents(spark, {"big": 2}))
    got = mixing.interleave(docs, block_rows=4, resolution=20).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert len({(r.slot, r.place) for r in got}) == len(got)
    assert len({r.source for r in got if r.slot == 0}) == 1
    for s in {r.source for r in got}:
        assert sorted((r.block, r.place) for r in got if r.source == s) == [(i // 4, i % 4) for i in range(sum(r.source == s for r in got))]
    assert mixing.interleave(docs.limit(0)).count() == 0
    assert docs.columns == mixing.mixed_documents(docs).columns and mixing.mixed_documents(docs).count() == len(got)


@pytest.mark.parametrize("shards", [8, 3])
def test_shards(spark, shards):
    docs = documents(spark, {"big": 90, "mid": 44, None: 5}).unionByName(documents(spark, {"big": 2}))
    docs = docs.unionByName(spark.createDataFrame([(None, None, None, None), (-5, "", "mid", None), (-6, "é" * 50_000, "mid", None)], DOC))
    rows, got = docs.collect(), sharding.assign(docs, shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows
    )
    per = Counter(r.shard for r in got)
    assert max(per.values()) - min(per.values()) <= 1 and set(per) == set(range(shards))
    for k in per:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(per[k]))
    for s in {r.source for r in got}:
        n = sum(r.source == s for r in got)
        here = Counter(r.shard for r in got if r.source == s)
        assert all(abs(here[k] - n * per[k] / len(got)) < 2 for k in per)
    # the order is that of the fractional ranks
    place = {(r.shard, r.slot): r for r in got}
    seen, total, last = Counter(), Counter(r.source for r in got), -1.0
    for key in sorted(place):
        s = place[key].source
        now = (2 * seen[s] + 1) / (2 * total[s])
        seen[s] += 1
        assert now >= last
        last = now
    assert sharding.assign(docs.limit(0)).count() == 0
    assert sharding.assign(docs.limit(3), 8).count() == 3


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = documents(spark, {"big": 30, None: 5}).unionByName(documents(spark, {"big": 2}))
    sharding.write_shards(docs.drop("slot"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 37 and back.select("shard", "slot").distinct().count() == 37
    assert back.where(F.col("text").isNull()).count() == 0 and math.isclose(back.select("shard").distinct().count(), 8)
