"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most three bits
agree in at least five of the eight positions, so a pair must reach five shared positional bytes.
Single bytes make posting lists that are far too long; but five agreeing positions always include three
within the first four or three within the last four, so the index posts each fingerprint under the
eight triples of positions inside those halves (24-bit keys). For the pairs of one posting list the
shared positional bytes are tallied, pairs below five are dropped, the rest are verified by bit count.

Exact copies share a fingerprint and are collapsed before; a posting list gives links that connect what
it connects (a spanning forest where it is long), never all pairs of a dense group. Posting lists longer
than ``BLOCK`` are cut into blocks and every pair of blocks is a task of its own. Of N fingerprints without
relation a list holds N / 2^24, so about N^2 / 2^22 pairs are tallied: 10^9 fingerprints make 240 pairs each.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.llm.common import bounded_batches, connected_components, cut, fresh, join_hot, small, table

BITS, SEED, WORDS, MAX_DIFFERING, POSITIONS = 64, 42, 3, 3, 8
#: Positions that must agree: each differing bit spoils one at most.
MIN_SHARED = POSITIONS - MAX_DIFFERING
TRIPLES = [*itertools.combinations(range(4), 3), *itertools.combinations(range(4, 8), 3)]
#: Fingerprints of one posting list that one task compares; longer lists are cut into blocks of this size.
BLOCK = 4096
#: Up to this length a list is compared pair by pair, beyond it by growing a spanning forest.
SHORT = 48


def _first_triple() -> np.ndarray:
    """For each set of agreeing positions (a byte), the first index key the pair shares; 255 if none."""
    out = np.full(256, 255, np.uint8)
    for mask in range(256):
        for k, triple in enumerate(TRIPLES):
            if all(mask >> p & 1 for p in triple):
                out[mask] = k
                break
    return out


_FIRST = _first_triple()


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned integer; a text without words has fingerprint zero."""
    import xxhash

    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text is counted in pieces
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_hash: Column | None = None) -> DataFrame:
    """(doc_id, fp, h): the fingerprint's 64 bits as a signed long, and ``row_hash``. A null text counts as empty."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64()), batch.column(2)], names=["doc_id", "fp", "h"])

    bounded_batches(docs.sparkSession)
    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        (F.lit(0).cast("long") if row_hash is None else row_hash).alias("h"),
    )
    return picked.mapInArrow(run, "doc_id long, fp long, h long")


def _tally_and_verify(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair is within MAX_DIFFERING bits, and its mask of agreeing positions."""
    differ = a ^ b
    mask = np.packbits(differ.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little").ravel()
    shared = np.bitwise_count(mask)
    good = shared >= MIN_SHARED
    good[good] = np.bitwise_count(differ[good]) <= MAX_DIFFERING
    return good, mask


def _grow_forest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints of one list."""
    left, out_a, out_b = values.copy(), [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            node = frontier.pop()
            near, _ = _tally_and_verify(np.full(len(left), node), left)
            if near.any():
                reached = left[near]
                out_a.append(np.full(len(reached), node))
                out_b.append(reached)
                frontier.extend(reached)
                left = left[~near]
    empty = np.empty(0, np.uint64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def _list_links(keys: np.ndarray, ordinals: np.ndarray, values: np.ndarray):
    """Links inside the posting lists of one sorted batch; ``keys`` marks list membership."""
    n = len(values)
    if n < 2:
        return
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, n])
    short = np.repeat(lengths <= SHORT, lengths)
    for gap in range(1, min(SHORT, n)):
        same = np.flatnonzero((keys[gap:] == keys[:-gap]) & short[gap:])
        if not len(same):
            break
        a, b = values[same], values[same + gap]
        good, mask = _tally_and_verify(a, b)
        good &= _FIRST[mask] == ordinals[same]  # a pair that several lists share is kept by the first
        yield a[good], b[good]
    for s, m in zip(starts[lengths > SHORT], lengths[lengths > SHORT], strict=True):
        yield _grow_forest(values[s : s + m])


def _links_in_lists(batches):
    """Arrow batches sorted by (k, key) -> edges; a list may run over a batch's end."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            now = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            rest = now if rest is None else tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
            if not len(rest[0]):
                continue
            # the last list may go on in the next batch
            last = np.flatnonzero((rest[0] != rest[0][-1]) | (rest[1] != rest[1][-1]))
            stop = last[-1] + 1 if len(last) else 0
        elif rest is None:
            return
        else:
            stop = len(rest[0])
        k, key, fp = (x[:stop] for x in rest)
        rest = tuple(x[stop:] for x in rest)
        for a, b in _list_links((k.astype(np.int64) << 40) | key, k, fp.view(np.uint64) if stop else fp.astype(np.uint64)):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _links_of_blocks(key, pdf):
    """Links across two blocks of one long list (or within one block)."""
    import pandas as pd

    values = np.unique(pdf["fp"].to_numpy().view(np.uint64))
    a, b = _grow_forest(values)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what links of <= 3 bits connect."""
    # the null-safe distinct set of fingerprints, posted under eight keys of three positional bytes each
    distinct = prints.select("fp").distinct()
    positional = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    postings = F.array(
        *[
            F.struct(
                F.lit(k).cast("int").alias("k"),
                (
                    F.shiftleft(positional(t[0]), 16).bitwiseOR(F.shiftleft(positional(t[1]), 8)).bitwiseOR(positional(t[2]))
                ).alias("key"),
            )
            for k, t in enumerate(TRIPLES)
        ]
    )
    index = distinct.select(F.explode(postings).alias("p"), "fp").select("p.k", "p.key", "fp")
    long_lists = (
        index.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).withColumnRenamed("k", "lk").withColumnRenamed("key", "lkey")
    )
    long_lists = cut(long_lists)
    on = (F.col("k") == F.col("lk")) & (F.col("key") == F.col("lkey"))
    short = index.join(long_lists, on, "left_anti")
    edges = short.repartition("k", "key").sortWithinPartitions("k", "key").mapInArrow(_links_in_lists, "a long, b long")
    if not long_lists.isEmpty():
        parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
        dealt = index.join(long_lists, on).withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        other = F.sequence(F.lit(0), F.col("parts") - 1)
        paired = dealt.select(
            "k", "key", "fp", "mine", F.explode(other).alias("o")
        ).select("k", "key", "fp", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"))
        edges = edges.unionByName(paired.groupBy("k", "key", "i", "j").applyInPandas(_links_of_blocks, "a long, b long"))
    return edges


def classes(prints: DataFrame, *more: Column) -> DataFrame:
    """One row per fingerprint: ``rows`` that have it, its first row ``w`` (null ids last) and ``more`` aggregates."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("w")
    return prints.groupBy("fp").agg(F.count(F.lit(1)).alias("rows"), first, *more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat an id are each
    returned. A null id stays null and never names a component; a component without any id is null.
    Other columns are ignored, whatever their names. An empty table gives an empty result. The rows of one
    fingerprint find their component by broadcast where they are many, so copies are never gathered.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    kinds = cut(classes(prints))
    groups = connected_components(links(prints))
    named = kinds.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "rows", F.col("w.doc_id").alias("rep"), F.coalesce("component", "fp").alias("comp"))
    smallest = named.groupBy(F.col("comp").alias("c")).agg(F.min("rep").alias("component_id"))
    label = cut(named.join(smallest, F.col("comp") == F.col("c")).select("fp", "rows", "component_id"))
    return join_hot(prints.select("doc_id", "fp"), "fp", label, "rows", prints.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, of each group of near-duplicates: that with the smallest id.

    Among rows that share this id the one with the smallest row hash stays, and one of rows that agree in
    everything; null ids come last. An empty table stays empty.
    """
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    prints = cut(fingerprints(docs, id_col, text_col, row_hash))
    return keep_first(docs, prints, cut(classes(prints)), connected_components(links(prints)), row_hash, id_col)


def keep_first(docs: DataFrame, prints: DataFrame, kinds: DataFrame, groups: DataFrame, row_hash: Column, id_col: str) -> DataFrame:
    """The row of ``docs`` with the smallest id of each group; fingerprints outside ``groups`` are their own.

    Winners are found among the fingerprints, one row each; the rows to go are then taken away from ``docs``,
    by broadcast where they are few.
    """
    grouped = kinds.join(groups, F.col("fp") == F.col("node"), "left")
    winners = grouped.groupBy(F.coalesce("component", "fp").alias("comp")).agg(F.min("w").alias("w")).select("w.doc_id", "w.h")
    wid, wh, key, hashed, nth = fresh(docs.columns, "wid", "wh", "id", "h", "nth")
    rows = prints.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.h") == F.col("r.h"))
    losers = cut(rows.alias("l").join(winners.alias("r"), same, "left_anti").select(F.col("doc_id").alias(wid), F.col("h").alias(wh)))
    again = cut(rows.where("n > 1").alias("l").join(winners.alias("r"), same, "left_semi").select(F.col("doc_id").alias(wid), F.col("h").alias(wh)))
    own = docs.withColumn(key, F.col(f"`{id_col}`").cast("long")).withColumn(hashed, row_hash)
    on = F.col(key).eqNullSafe(F.col(wid)) & (F.col(hashed) == F.col(wh))
    kept = own.join(small(losers), on, "left_anti")
    if not again.isEmpty():  # of winners that agree in everything one stays
        numbered = kept.join(small(again), on, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(key, hashed).orderBy(hashed)))
        kept = kept.join(small(again), on, "left_anti").unionByName(numbered.where(F.col(nth) == 1).drop(nth))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
