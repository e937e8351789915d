"""Sharding by proportional stratified interleaving.

Rows are put in a seeded random order within each source; the row of rank i among n gets the fractional
rank (i + 1/2) / n. Sorted by it, every stretch of the whole order holds each source in proportion, so
cutting the order into equal stretches gives shards that all match the mixture. Row counts of shards
differ by at most one. Both ranks are taken bucket by bucket (see ``distributed_rank``): neither a source
nor the whole table is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.llm import mixing
from stratalog.llm.common import cut, distributed_rank, fresh, rank_buckets, table

SHARDS, SEED = 8, 17


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, h): what the order needs of each row, without its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return slim.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of every row of ``docs``.

    ``slot`` is the row's place in its shard, from 0 without gaps. A null text has size 1 and checksum 0; a
    null source is a source of its own; rows that agree in everything are interchangeable but all kept.
    Other columns are ignored. With fewer rows than shards some shards stay empty.
    """
    rows = cut(digests(docs, seed))
    tie = ["h", "doc_id", "text_crc32", "size"]
    buckets = rank_buckets(rows.count())
    bits = buckets.bit_length() - 1
    ranked = cut(distributed_rank(rows, ["source"], tie, F.shiftright("h", 64 - bits), "rank", "of"))
    placed = ranked.withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("of")))
    whole = distributed_rank(
        placed, [], ["fraction", "source", *tie], F.floor(F.col("fraction") * buckets).cast("int"), "place", "rows"
    )
    shard = F.expr(f"(place * {shards}L) div rows")
    first = F.expr(f"(shard * rows + {shards - 1}L) div {shards}L")
    return whole.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot")
    )


def deal(docs: DataFrame, weights: dict[str, float] | None = None, shards: int = SHARDS) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of every row, dealt in the order of the mixture.

    Blocks of the mixture are a multiple of ``shards`` long, so each shard gets its part of every block: in
    every shard the places follow the target weights, and sources are in proportion over whole shards.
    Null texts and sources, repeated rows, other columns and few rows are treated as in ``assign``; an empty
    table gives an empty result.
    """
    rows = cut(digests(docs).drop("h"))
    total = rows.count()
    block_rows = mixing.rows_of_block(total, shards * -(-mixing.BLOCK_ROWS // shards))
    placed = cut(mixing.interleave(rows, weights, block_rows, tie=("text_crc32", "size")).drop("block", "release", "deadline"))
    last = placed.agg(F.max("slot")).first()[0] or 0
    bucket = F.expr(f"(slot * {rank_buckets(total)}L) div {last + 1}L").cast("int")
    whole = distributed_rank(placed, [], ["slot", "place"], bucket, "at")
    return whole.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.expr(f"at % {shards}L").cast("int").alias("shard"),
        F.expr(f"at div {shards}L").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write every row with its columns below ``path``/shard=k, sorted by slot within each file.

    A column ``shard`` or ``slot`` of ``docs`` is replaced by the row's own; other columns may have any
    names. Repeated rows meet their places one to one; a null text, source or id is a value like any other.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")])
    crc, i, of, source, nth, mth = fresh([*kept.columns, "shard", "slot"], *"crc id of source nth mth".split())
    own = kept.withColumn(crc, F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    own = own.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", crc, "source").orderBy(crc)))
    places = assign(docs, shards, seed).select(F.col("doc_id").alias(i), F.col("text_crc32").alias(of), F.col("source").alias(source), "shard", "slot")
    places = places.withColumn(mth, F.row_number().over(Window.partitionBy(i, of, source).orderBy("shard", "slot")))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(crc) == F.col(of)) & F.col("source").cast("string").eqNullSafe(F.col(source))
    out = own.join(places, on & (F.col(nth) == F.col(mth))).drop(crc, i, of, source, nth, mth)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
