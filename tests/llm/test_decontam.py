import hashlib
import re

import duckdb
import pandas as pd
from pyspark.sql import types as T

from stratalog.llm import decontam

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType())])
ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.LongType())])
PASSAGE = "One two, three FOUR five six seven eight nine ten éleven"


def frames(spark):
    docs = [
        (1, f"before {PASSAGE} after", "x"),
        (2, "one two three four five six seven eight nine", None),
        (3, "Say: Short-Item! again short item", "x"),
        (4, None, "x"),
        (5, "", "x"),
        (None, f"{PASSAGE}. {PASSAGE}", "x"),
        (1, f"before {PASSAGE} after", "x"),
        (6, "word " * 200_000 + PASSAGE, "x"),
        (7, "one two three four five six seven eight nine ten", "x"),
        (8, "said AGAIN.", "x"),
    ]
    items = [(10, PASSAGE, 1), (9, "short ITEM", 1), (9, "short ITEM", 2), (11, None, 3), (12, "...", 4), (None, "again", 5)]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)


def brute(docs, items):
    """The contract by loops: every window of every item looked for at every word."""
    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    patterns = {}
    for item_id, text, *_ in items:
        words = split(text)
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            patterns.setdefault(tuple(words[i : i + size]), set()).add(item_id)
    sizes, out = {len(p) for p in patterns}, []
    for doc_id, text, *_ in docs:
        words, hit, names = split(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (found := patterns.get(tuple(words[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    names |= found - {None}
        told = ",".join(sorted(map(str, names)))
        out.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(told.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_loops_and_in_parts(spark):
    docs, items = frames(spark)
    want = brute(docs.collect(), items.collect())
    for nodes in (decontam.MAX_NODES, 500):
        got = decontam.verdicts(decontam.scan(docs, items, nodes)).collect()
        assert sorted(map(tuple, got), key=str) == want
        assert sorted(r.doc_id for r in decontam.clean_documents(docs, items, nodes).collect()) == [2, 4, 5, 7]
    by_id = {r[0]: r for r in got}
    assert by_id[1][2] == 11 and by_id[3][2] == 5 and not by_id[7][5] and by_id[6][1] == 200_011 and by_id[8][2:4] == (1, 0)


def test_against_oracle(spark):
    docs, items = frames(spark)
    d, i = docs.toPandas(), items.toPandas()
    d["doc_id"] = d["doc_id"].astype("Int64").fillna(-1)
    i["item_id"] = i["item_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", d.drop_duplicates())
    con.register("benchmark", i)
    got = {(-1 if r[0] is None else r[0], *r[1:]) for r in decontam.verdicts(decontam.scan(docs, items)).collect()}
    assert sorted(got) == sorted(con.execute(decontam.ORACLE).fetchall())


def test_spans_point_into_the_original(spark):
    docs, items = frames(spark)
    rows = decontam.with_spans(decontam.scan(docs, items.where("item_id IS NOT NULL"))).where("doc_id = 3").collect()
    assert [rows[0].text[s.start : s.end] for s in rows[0].spans] == ["Short-Item", "short item"]


def test_clean_documents_keeps_rows_and_columns(spark):
    docs, items = frames(spark)
    kept = decontam.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7]
    assert decontam.clean_documents(docs, items.limit(0)).count() == docs.count()
    assert decontam.scan(docs.limit(0), items).count() == 0
    assert isinstance(kept.toPandas(), pd.DataFrame)
