"""Benchmark decontamination with one Aho-Corasick automaton over the normalised benchmark texts.

Texts and items are normalised alike: A-Z is lower-cased and words are runs of ASCII letters, digits and
all characters beyond ASCII. Every window of ten consecutive words of an item (a shorter item is one
window) is a pattern, framed by single spaces. A document is joined to one such string of words and read
once; ends of matches are mapped to word numbers, and these to code points of the original text.

The automaton is built in each Python worker from the broadcast items. Its nodes are bounded first, by the
bytes of all windows: up to ``MAX_NODES`` make one automaton. A larger benchmark is cut into several, each
with a pass of its own over the texts, so that a worker never holds more than one; such a pass returns only
the rows that it hits, which the last pass merges.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import bounded_batches, cut, small, table

WINDOW = 10
#: Nodes of one automaton; one takes some 50 bytes.
MAX_NODES = 6_000_000
#: A word of a text as it is, before A-Z is lower-cased.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Maps A-Z to a-z and every other ASCII character that is not a letter or digit to a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

FOUND = "doc_id long, text string, n_words long, hits array<long>, items array<long>"


def _words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, in order; only ASCII characters part words."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def normalised(text: str | None) -> list[str]:
    return [w.decode("utf-8") for w in _words(text)]


def windows(items: list[tuple[int | None, str]], size: int = WINDOW) -> dict[str, tuple[int, list[int]]]:
    """Pattern -> (its words, ids of the items that hold it). An item without an id has patterns but no name."""
    found: dict[str, tuple[int, list[int]]] = {}
    for item_id, text in items:
        words = normalised(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            part = words[i : i + size]
            ids = found.setdefault(" " + " ".join(part) + " ", (len(part), []))[1]
            if item_id is not None and item_id not in ids:
                ids.append(item_id)
    return found


_BUILT: dict[str, object] = {}


def _automaton(handle) -> object:
    """The automaton of one broadcast, built once for each Python worker."""
    import ahocorasick

    if handle.key not in _BUILT:
        _BUILT.clear()
        made = ahocorasick.Automaton()
        for pattern, value in windows(handle.items.value).items():
            made.add_word(pattern, value)
        made.make_automaton()
        _BUILT[handle.key] = made
    return _BUILT[handle.key]


class _Handle:
    def __init__(self, key: str, items) -> None:
        self.key, self.items = key, items


def _scan(text: str | None, automaton) -> tuple[int, list[int], set[int]]:
    """Words of a text, hit word ranges as a flat list [first, past, ...] in order, and the items found."""
    words = _words(text)
    if not words or not len(automaton):
        return len(words), [], set()
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8")
    ranges, items, ends = [], set(), None
    for at, (length, ids) in automaton.iter(joined):
        if ends is None:  # where each word's following space is
            ends, here = [], 0
            for w in joined[1:-1].split(" "):
                here += len(w) + 1
                ends.append(here)
        past = bisect.bisect_left(ends, at) + 1
        ranges.append((past - length, past))
        items.update(ids)
    return len(words), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[int]:
    """Union of half-open ranges, flat and in order."""
    flat: list[int] = []
    for first, past in sorted(ranges):
        if flat and first <= flat[-1]:
            flat[-1] = max(flat[-1], past)
        else:
            flat += [first, past]
    return flat


def _pass(handle):
    """Scans texts; ``found`` lists (hits, items) of the row in other parts of the benchmark."""

    def run(batches):
        automaton = None
        for batch in batches:
            automaton = automaton or _automaton(handle)
            counts, hits, items = [], [], []
            for value, others in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                n, flat, ids = _scan(value.as_py(), automaton)
                if others:
                    lists = [flat, *(o["hits"] for o in others)]
                    flat = merged([r for x in lists for r in zip(x[::2], x[1::2], strict=True)])
                    ids = ids.union(*(o["items"] for o in others))
                counts.append(n)
                hits.append(flat)
                items.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, LIST), pa.array(items, LIST)],
                names=["doc_id", "text", "n_words", "hits", "items"],
            )

    return run


LIST = pa.list_(pa.int64())


def _partial_pass(handle):
    """(key, hits, items) of the texts that are hit."""

    def run(batches):
        automaton = None
        for batch in batches:
            automaton = automaton or _automaton(handle)
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, flat, ids = _scan(value.as_py(), automaton)
                if flat:
                    rows.append((key, flat, sorted(ids)))
            key, hits, items = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(hits, LIST), pa.array(items, LIST)], names=["key", "hits", "items"])

    return run


def _handles(benchmark: DataFrame, max_nodes: int) -> list[_Handle]:
    """The benchmark in broadcasts whose windows have at most about ``max_nodes`` bytes each."""
    spark = benchmark.sparkSession
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        .where("text IS NOT NULL")
        .distinct()
    )
    total = items.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    chunks = max(1, math.ceil(total * WINDOW / max_nodes))
    made = []
    for c in range(chunks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c)
        rows = [(r[0], r[1]) for r in mine.orderBy("item_id", "text").collect()]
        made.append(_Handle(uuid.uuid4().hex, spark.sparkContext.broadcast(rows)))
    return made


def scan(docs: DataFrame, benchmark: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """(doc_id, text, n_words, hits, items) for each document.

    ``hits`` holds half-open ranges of word numbers as a flat list, merged and in order; ``items`` the ids
    of items with a window that occurs, in order. A null or empty text has no words. Items without words
    or a text are no patterns; the windows of an item without an id hit, but name no item. An empty
    benchmark hits nothing. Repeated documents and items are treated row by row, other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    first, *others = _handles(benchmark, max_nodes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = F.lit(None).cast("array<struct<hits:array<bigint>,items:array<bigint>>>")
    if not others:
        return rows.select("doc_id", "text", found.alias("found")).mapInArrow(_pass(first), FOUND)
    # equal texts have equal hits, so a hash of the text finds them again
    texts, parts = rows.select(F.xxhash64("text").alias("key"), "text"), []
    for handle in others:
        part = texts.mapInArrow(_partial_pass(handle), "key long, hits array<long>, items array<long>").dropDuplicates(["key"])
        parts.append(part.select("key", F.struct("hits", "items").alias("f")))
    hit = cut(functools.reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.collect_list("f").alias("found")))
    joined = rows.withColumn("of", F.xxhash64("text")).join(small(hit), F.col("of") == F.col("key"), "left")
    return joined.select("doc_id", "text", "found").mapInArrow(_pass(first), FOUND)


def spans(text: str | None, hits: list[int]) -> list[tuple[int, int]]:
    """Hit word ranges as half-open ranges of code points of the original text."""
    if not text or not hits:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in zip(hits[::2], hits[1::2], strict=True)]


def with_spans(scanned: DataFrame) -> DataFrame:
    """Adds ``spans``, the hit passages as [start, end) code points of the original text."""

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def located(text, hits):
        import pandas as pd

        return pd.Series([[{"start": a, "end": b} for a, b in spans(t, list(h))] for t, h in zip(text, hits, strict=True)])

    return scanned.withColumn("spans", located("text", "hits"))


def verdicts(scanned: DataFrame) -> DataFrame:
    """One row per document with the number of hit words and a digest of the items found."""
    odd = F.filter("hits", lambda x, i: i % 2 == 1)
    even = F.filter("hits", lambda x, i: i % 2 == 0)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = total(odd) - total(even)
    return scanned.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, in which no window of an item occurs.

    Rows with a null or empty text stay, repeated rows are treated one by one, an empty benchmark takes
    nothing away and an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    out, at = docs, docs.columns.index("text")
    for handle in _handles(benchmark, max_nodes):

        def run(batches, handle=handle):
            automaton = None
            for batch in batches:
                automaton = automaton or _automaton(handle)
                keep = [not _scan(t.as_py(), automaton)[1] for t in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        if out is not docs:  # one automaton at a time in a worker
            out = cut(out)
        out = out.mapInArrow(run, docs.schema)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


#: A plain rendering: all word windows of the documents joined with all windows of the items.
ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT l FROM patterns),
tokens AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
ahead AS (
  SELECT doc_id, i, n, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o, lead(word, 8) OVER o, lead(word, 9) OVER o] AS next
  FROM tokens WINDOW o AS (PARTITION BY r ORDER BY i)),
places AS (SELECT doc_id, l, i, array_to_string(next[1:l], ' ') AS p FROM ahead, lengths WHERE i + l - 1 <= n),
found AS (SELECT doc_id, item_id, i, places.l AS l FROM places JOIN patterns USING (l, p)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS j FROM found) GROUP BY doc_id),
held AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar))) AS s FROM found GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""
