"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in a seeded random order, form blocks of ``block_rows`` rows. With a target weight of
a/Q the block i of a source may not come before slot floor(i*Q/a), its release time, and must come before
slot ceil((i+1)*Q/a), its deadline. Earliest-deadline-first among released blocks meets all deadlines
when the weights sum to one, so at every slot each source has had within less than one block of its
share a/Q. Releases and deadlines repeat after Q slots, hence so does the schedule: block i of a source goes
to slot (i div a)*Q + its (i mod a)-th slot of the period. Target weights are rounded to multiples of 1/Q by
largest remainder, and Q is the number of all blocks at least: over as many slots rounding moves a source
by less than one block more. Only a source that would get no slot is given one, at the cost of the others.

Every row is placed exactly once. When a source runs out its slots stay empty; the guarantee then goes on
for the others in the schedule's slots. All of it is DataFrame and SQL functions.

The schedule is made slot after slot in one task and its time is slots times sources. Blocks of a large
table are made so much larger that it has about ``MOST_SLOTS`` slots at most; the number of sources is
taken to be small (thousands), as each must be looked at for each slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.llm.common import cut, distributed_rank, fresh, rank_buckets, table

SEED, BLOCK_ROWS, RESOLUTION = 23, 16, 1000
#: Blocks of all sources together, about; beyond, a block has more rows.
MOST_SLOTS = 1 << 20
#: Without given weights a source weighs its row count to this power.
TEMPER = 0.5
#: Slots of a schedule that are listed together.
PIECE = 1000
#: A schedule of more slots is joined by shuffle.
BROADCAST_SLOTS = 1 << 18
#: What the schedule adds to a row.
PLACED = ("block", "release", "deadline", "slot", "place")


def shares(
    sizes: DataFrame, weights: dict[str, float] | None, resolution: int, temper: float = TEMPER, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row: ``names`` and ``a``, the sources in order and their slots of a period of ``q`` slots.

    ``sizes`` has (source, n). Largest remainders are rounded up until the slots add up. A source without
    a given weight takes the smallest given one. The period has four slots for each source at least, and
    one for each block of ``block_rows`` rows.
    """
    if weights:
        known = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))])
        weight = F.coalesce(F.element_at(known, F.col("source")), F.lit(float(min(weights.values()))))
    else:
        weight = F.pow(F.col("n").cast("double"), F.lit(temper))
    everything = Window.partitionBy()
    blocks = F.ceil(F.col("n") / F.lit(block_rows)).cast("long")
    weighed = sizes.select("source", weight.alias("w"), blocks.alias("blocks")).select(
        "source",
        (F.col("w") / F.sum("w").over(everything)).alias("w"),
        F.greatest(
            F.lit(resolution).cast("long"), 4 * F.count(F.lit(1)).over(everything), F.sum("blocks").over(everything)
        ).alias("q"),
    )
    ideal = F.col("w") * F.col("q")
    floors = weighed.withColumn("base", F.floor(ideal).cast("long")).withColumn("part", ideal - F.floor(ideal))
    left = floors.withColumn("left", F.col("q") - F.sum("base").over(everything)).withColumn(
        "nth", F.row_number().over(everything.orderBy(F.desc("part"), "source"))
    )
    rounded = left.withColumn("a", F.greatest(F.lit(1), F.col("base") + (F.col("nth") <= F.col("left")).cast("long")))
    # slots of sources that would have none are taken from the others in proportion
    over = F.sum("a").over(everything) - F.col("q")
    so_far = F.sum(F.col("a") - 1).over(everything.orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    spared = rounded.withColumn("over", over).withColumn("c", so_far).withColumn("all", F.sum(F.col("a") - 1).over(everything))
    taken = "(if(all = 0, 0L, (over * c) div all) - if(all = 0, 0L, (over * (c - a + 1)) div all))"
    dealt = spared.select("source", "q", F.expr(f"a - {taken}").cast("long").alias("a"))
    listed = dealt.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("source", "a"))).alias("s"))
    return listed.select("q", F.col("s.source").alias("names"), F.col("s.a").alias("a"))


def period(shared: DataFrame) -> DataFrame:
    """(source, j, a, q, at): the slot ``at`` of the j-th block of each source in one period."""
    released = "(st.i[s] * q) div a[s] <= t"
    deadline = "((st.i[s] + 1) * q + a[s] - 1) div a[s]"
    pick = (
        f"array_min(transform(filter(sequence(0, size(a) - 1), s -> {released}), "
        f"s -> named_struct('d', {deadline}, 'a', -a[s], 's', s))).s"
    )
    step = (
        f"(st, t) -> transform(array({pick}), p -> named_struct("
        "'i', transform(st.i, (v, s) -> v + if(s = p, 1L, 0L)), 'out', array_append(st.out, p)))[0]"
    )
    # slots are appended to short pieces, as an append copies its array
    piece = (
        f"aggregate(sequence(c * {PIECE}L, least(q, (c + 1) * {PIECE}L) - 1), "
        f"named_struct('i', o.i, 'out', cast(array() as array<int>)), {step})"
    )
    fold = (
        f"flatten(aggregate(sequence(0L, (q - 1) div {PIECE}L), "
        "named_struct('i', array_repeat(0L, size(a)), 'outs', cast(array() as array<array<int>>)), "
        f"(o, c) -> transform(array({piece}), r -> named_struct('i', r.i, 'outs', array_append(o.outs, r.out)))[0], o -> o.outs))"
    )
    slots = shared.select("q", "names", "a", F.expr(fold).alias("order")).select(
        "q", "names", "a", F.posexplode("order").alias("at", "s")
    )
    nth = F.row_number().over(Window.partitionBy("s").orderBy("at")) - 1
    return slots.select(
        F.expr("names[s]").alias("source"), nth.cast("long").alias("j"), F.expr("a[s]").alias("a"), "q", F.col("at").cast("long").alias("at")
    )


def rows_of_block(rows: int, least: int = BLOCK_ROWS) -> int:
    """The size of a block for a table of so many rows: a multiple of ``least``."""
    return least * max(1, -(-rows // (least * MOST_SLOTS)))


def _placed(docs: DataFrame, weights: dict[str, float] | None, block_rows: int | None, resolution: int, seed: int, tie: tuple[str, ...], names: list[str]) -> DataFrame:
    """The rows of ``docs`` with the columns ``PLACED`` under ``names``, which are new ones."""
    source, h, rank, s, a, q, j, t, k, at = fresh([*docs.columns, *names], *"source h rank s a q j t k at".split())
    total = docs.count()
    size = block_rows or rows_of_block(total)
    rows = docs.withColumn(source, F.col("source").cast("string")).withColumn(h, F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")))
    bits = rank_buckets(total).bit_length() - 1
    ranked = distributed_rank(rows, [source], [h, "doc_id", *tie], F.shiftright(h, 64 - bits), rank)
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    # a period has as many rows as slots, one for each block of rows at least
    plan = cut(period(shares(sizes, weights, resolution, block_rows=size)))
    lengths = plan.select(F.col("source").alias(s), F.col("a").alias(a), F.col("q").alias(q)).distinct()
    with_share = ranked.join(F.broadcast(lengths), F.col(source).eqNullSafe(F.col(s)))
    block, release, deadline, slot, place = names
    blocks = with_share.withColumn(block, F.expr(f"{rank} div {size}L")).withColumn(j, F.expr(f"`{block}` % {a}"))
    slots = plan.select(F.col("source").alias(t), F.col("j").alias(k), F.col("at").alias(at))
    if plan.count() <= BROADCAST_SLOTS:
        slots = F.broadcast(slots)
    placed = blocks.join(slots, F.col(source).eqNullSafe(F.col(t)) & (F.col(j) == F.col(k)))
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        block,
        F.expr(f"(`{block}` * {q}) div {a}").alias(release),
        F.expr(f"((`{block}` + 1) * {q} + {a} - 1) div {a}").alias(deadline),
        F.expr(f"(`{block}` div {a}) * {q} + {at}").alias(slot),
        F.expr(f"{rank} % {size}L").alias(place),
    )


def interleave(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_rows: int | None = None,
    resolution: int = RESOLUTION,
    seed: int = SEED,
    tie: tuple[str, ...] = (),
) -> DataFrame:
    """The rows of ``docs`` with block, release, deadline, slot and place (the row's place in its block).

    (slot, place) is the order of the mixture. A null source is a source of its own; repeated rows are all
    placed, in the order of the columns ``tie``; rows without an id come first of those with equal hash.
    Columns of ``docs`` with the names of the added ones are left out, see ``mixed_documents`` for all of
    them. An empty table gives an empty result.
    """
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in PLACED])
    return _placed(own, weights, block_rows, resolution, seed, tie, list(PLACED))


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """The rows and columns of ``docs`` in the order of the mixture: partition by partition, row by row.

    Columns may have any names. Null sources, repeated rows and empty tables are treated as in ``interleave``.
    """
    names = fresh(docs.columns, *PLACED)
    placed = _placed(docs, weights, None, RESOLUTION, seed, (), names)
    parts, order = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), names[3:]
    return placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return interleave(docs)
