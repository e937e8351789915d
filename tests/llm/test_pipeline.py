import corpus_pipeline
from stratalog.llm import decontam, registry, simhash, toxicity
from test_similar import kept_by_all_pairs
from stratalog.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_stages_decide_and_keep_the_rest(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "sharding":
            assert docs.columns == before.columns
        if name == "toxicity":
            model = toxicity.train(before, table(spark, DATA, "labels"))
            assert docs.count() == toxicity.score(before, model).where("score < 0.5").count()
        if name == "near_duplicates":
            rows = sorted((r.doc_id, r.text) for r in before.collect())
            assert sorted(r.doc_id for r in docs.collect()) == kept_by_all_pairs(rows)
        if name == "decontamination":
            clean = decontam.verdicts(decontam.scan(before, table(spark, DATA, "benchmark"))).where("not contaminated")
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in clean.collect()}
        if name in ("mixing", "sharding"):
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in before.collect())
    per = [r["count"] for r in seen["sharding"].groupBy("shard").count().collect()]
    assert max(per) - min(per) <= 1


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _id string, slot string, __n string, score double, wid long"


def test_stages_with_nulls_ties_and_clashing_names(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [
        (1, words, "en", "a", 9, "x", "s1", "n", 0.5, 7), (2, words + " more", "en", None, 9, None, "s2", None, None, None), (3, None, None, None, None, "y", None, "n", 1.0, 1),
        (4, "", None, "a", 0, "y", "s4", "n", 1.0, 1), (None, "no id " + words[::-1], None, "b", 1, None, "s5", None, None, None), (5, "long " * 100_000, None, "a", 1, "z", "s6", "n", 2.0, 3),
        (6, "twice told tale", None, "b", 1, "z", "s7", "n", 2.0, 3), (6, "twice told tale", None, "b", 1, "z", "s7", "n", 2.0, 3),
    ]
    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    whole = {r[0]: r for r in rows}
    for first in (spark.createDataFrame(rows, CLASH), spark.createDataFrame([], CLASH)):
        docs = first
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, str(tmp_path))
            if name != "sharding":
                assert docs.columns == before.columns
                assert all(tuple(r) == whole[r.doc_id] for r in docs.collect())
        kept = sorted((r.doc_id for r in docs.collect()), key=str)
        assert kept == ([1, 3, 5, 6, None] if first.count() else [])


def test_rows_that_repeat_keep_one(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s"), (None, "q r s"), (5, "x y z w"), (4, "x y z w")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(kept.collect(), key=str) == sorted([(1, "a b c d"), (None, "q r s"), (4, "x y z w")], key=str)


def test_registered_names():
    assert [f"op{n}" for n in range(1, 11)] == [q.split("_")[0] for q in registry.queries()]
    assert set(registry.oracle_sql()) <= set(registry.queries()) and set(corpus_pipeline.queries()) == {"pipeline"}
