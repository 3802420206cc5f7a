"""Sharding in Hilbert-curve order, in DataFrame functions only.

Several metadata dimensions are quantised to a grid, cells of the grid are ordered along a
Hilbert curve, and the documents in that order are cut into runs with counts at most
one apart. A shard then covers a compact region in all dimensions at once, so minima and
maxima kept for each file rule out most files for a filter on any of them.

Rows with equal texts are one group. A group has the cell of its first row, whatever the metadata of the others, so that it stands
together in the order; only where a cut between two shards falls into a group, or a shard is smaller than it, is it divided.

No step sorts the corpus. The table is read once, for a narrow copy without texts. A cell is spread over lanes by a
hash of the text, as many as its count needs, and a lane that one text makes too large is spread again by row.
An aggregation counts rows by (cell, lane), and a running sum over those counts gives the rank at which each lane
begins. Rows are then numbered inside their lanes only, in an order in which equal texts of a lane stand together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftscan.llm.store import let, materialize

SHARDS = 40
#: Cells of a dimension are 2 ** BITS; a lane, which one task numbers, has about LANE_ROWS rows.
BITS, LANE_ROWS = 4, 500_000


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """The position (long) on the Hilbert curve of a cell with coordinates in 0 .. 2**bits - 1.

    Skilling's transform as a fold over bit levels and axes: exchange or invert low bits
    from the highest level down, Gray-encode, and interleave.
    """
    n = len(coordinates)
    axes = F.sequence(F.lit(0), F.lit(n - 1))

    def replaced(x: Column, changes) -> Column:
        return F.transform(x, lambda v, k: changes(v, k).cast("int"))

    def step(x: Column, q: Column, i: Column) -> Column:
        low = q - 1
        first, own = F.get(x, F.lit(0)), F.get(x, i)
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        inverted = replaced(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(low)).otherwise(v))
        exchanged = replaced(x, lambda v, k: F.when((k == 0) | (k == i), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(own.bitwiseAND(q) != 0, inverted).when(i == 0, x).otherwise(exchanged)

    levels = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")
    x = F.array(*[c.cast("int") for c in coordinates])
    order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(k).alias("k")) for b in range(bits - 1, -1, -1) for k in range(n)])

    def gray(y: Column) -> Column:
        # each axis takes the exclusive or of all axes up to it
        return F.transform(y, lambda v, k: F.aggregate(F.slice(y, F.lit(1), k + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))

    def turned(y: Column) -> Column:
        last = F.element_at(y, n)
        flips = F.aggregate(levels, F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return let(flips, lambda t: F.transform(y, lambda v: v.bitwiseXOR(t)))

    def interleaved(y: Column) -> Column:
        bit = lambda o: F.call_function("shiftright", F.get(y, o["k"]), o["b"]).bitwiseAND(F.lit(1)).cast("long")
        return F.aggregate(order, F.lit(0).cast("long"), lambda acc, o: acc * 2 + bit(o))

    undone = F.aggregate(levels, x, lambda acc, q: F.aggregate(axes, acc, lambda a, i: step(a, q, i)))
    return let(undone, lambda u: let(gray(u), lambda g: let(turned(g), interleaved)))


def _bounds_of_words(rows: DataFrame, column: str, levels: list[float]) -> list[str]:
    """Quantiles of a string column over all rows.

    Distinct values are counted, dealt in ranges and summed range by range, so no task has to hold them all.
    """
    spark = rows.sparkSession
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(counts.repartitionByRange(n, "v").withColumn("p", F.spark_partition_id()))
    # one row for each range
    sums = dealt.groupBy("p").agg(F.sum("n").alias("s"))
    whole = Window.orderBy("p")
    before = sums.select("p", (F.sum("s").over(whole) - F.col("s")).alias("before"), F.sum("s").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    upto = dealt.join(before, "p").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("p").orderBy("v")))
    found = upto.agg(*[F.min(F.when(F.col("upto") >= F.lit(x) * F.col("all"), F.col("v"))).alias(f"b{k}") for k, x in enumerate(levels)]).first()
    return [v for v in found if v is not None]


def quantised(rows: DataFrame, dimensions: list[str], bits: int) -> DataFrame:
    """``rows`` with an int column _q0, _q1, ... in 0 .. 2**bits - 1 for each dimension.

    Boundaries are quantiles over all rows, 2**bits - 1 for each dimension; strings are compared whole. A null is in
    cell 0.
    """
    kinds = dict(rows.dtypes)
    levels = [k / (1 << bits) for k in range(1, 1 << bits)]
    words = {k for k, d in enumerate(dimensions) if kinds[d] in ("string", "binary")}
    numbers = [F.col(d).cast("string" if k in words else "double") for k, d in enumerate(dimensions)]
    asked = [F.percentile_approx(c, levels, 1000).alias(f"b{k}") for k, c in enumerate(numbers) if k not in words]
    found = rows.agg(*asked).first().asDict() if asked else {}
    out = {}
    for k, c in enumerate(numbers):
        values = _bounds_of_words(rows.select(c.alias("v")), "v", levels) if k in words else map(float, found[f"b{k}"] or [])
        # cells by the number of boundaries at or below the value
        out[f"_q{k}"] = F.coalesce(sum((F.when(c >= F.lit(x), 1).otherwise(0) for x in sorted(set(values))), F.lit(0)), F.lit(0)).cast("int")
    return rows.withColumns(out)


def _grouped(rows: DataFrame, axes: list[str]) -> DataFrame:
    """``rows`` in which those with equal texts have the cell of the first of them.

    Only groups that metadata would divide are joined, one row for each; their rows are found by aggregation, so copies are counted before they move.
    """
    group = ["_text", "size"]
    cell = F.struct(*axes)
    first = F.min_by(cell, F.struct("doc_id", "_id")).alias("_first")
    apart = rows.groupBy(*group).agg(first, F.min(cell).alias("_least"), F.max(cell).alias("_most")).where("_least <> _most").select(*group, "_first")
    return rows.join(apart, group, "left").withColumns({a: F.coalesce(F.col("_first")[a], F.col(a)) for a in axes}).drop("_first")


def hilbert_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    dimensions: tuple[str, ...] = ("source", "lang", "size"),
    bits: int = BITS,
    lane_rows: int = LANE_ROWS,
) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve.

    size is the UTF-8 bytes of the text plus 16 and may be a dimension; others are columns
    of ``docs``, and those it lacks are left out. law is "rows": counts of shards differ by one at
    most. slot numbers the rows of a shard from 0. grown_shard is null under this law.
    curve is the cell's position on the Hilbert curve and never falls from shard to shard.

    Defined cases: a null text has 16 bytes of size and the checksum of the empty text; nulls in
    a dimension share its first cell; a null doc_id is ordered first in its lane among equal texts; equal rows are
    numbered one after the other in any order; equal texts have the cell of the one with the least doc_id and stand together, and
    law "rows" divides those that a cut falls between; with fewer rows than shards the last shards are
    empty; an empty table gives no rows; clashing columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [d for d in dimensions if d != "size" and d in docs.columns]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
        *own,
    )
    used = [d for d in dimensions if d == "size" or d in own]
    rows = materialize(rows.withColumn("_id", F.monotonically_increasing_id()))
    axes = [f"_q{k}" for k in range(len(used))]
    cells = materialize(_grouped(quantised(rows, used, bits), axes).select("doc_id", "size", "text_crc32", "_text", "_id", *axes))
    by_text = F.pmod(F.col("_text"), F.col("_lanes"))
    wide = cells.groupBy(*axes).agg(F.ceil(F.count(F.lit(1)) / lane_rows).alias("_lanes"))
    cells = cells.join(wide, axes).withColumn("_lane", by_text).drop("_lanes")
    # one text, or few, can fill a lane: its rows are dealt again, evenly
    full = cells.groupBy(*axes, "_lane").agg(F.ceil(F.count(F.lit(1)) / (2 * lane_rows)).alias("_more"))
    cells = cells.join(full, [*axes, "_lane"])
    cells = cells.withColumn("_lane", F.struct("_lane", F.pmod(F.xxhash64("_id"), F.col("_more")).alias("_part"))).drop("_more")
    groups = cells.groupBy(*axes, "_lane").agg(F.count(F.lit(1)).alias("_n"))
    # cells are bounded by 2 ** (bits * dimensions), lanes by that and one for each lane_rows rows
    places = groups.select(*axes).distinct().withColumn("curve", hilbert_index([F.col(a) for a in axes], bits))
    curve = groups.join(places, axes)
    totals = curve.groupBy("curve").agg(F.sum("_n").alias("_cell"))
    along = Window.orderBy("curve")
    starts = totals.withColumns(
        {
            "_before": F.sum("_cell").over(along) - F.col("_cell"),
            "_total": F.sum("_cell").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    ).drop("_cell")
    inside = Window.partitionBy("curve").orderBy("_lane")
    placed = curve.withColumn("_inside", F.sum("_n").over(inside) - F.col("_n")).join(starts, "curve")
    placed = placed.select(*axes, "_lane", "curve", "_total", (F.col("_before") + F.col("_inside")).alias("_first"))
    numbered = cells.withColumn("_r", F.row_number().over(Window.partitionBy(*axes, "_lane").orderBy("text_crc32", "size", "_text", "doc_id", "_id")))
    ranked = numbered.join(placed, [*axes, "_lane"]).withColumn("_rank", F.col("_first") + F.col("_r") - 1)
    # the first _total % shards shards have one row more than the others
    small, more = F.floor(F.col("_total") / shards), F.col("_total") % shards
    wide = more * (small + 1)
    shard = F.when(F.col("_rank") < wide, F.floor(F.col("_rank") / (small + 1))).otherwise(more + F.floor((F.col("_rank") - wide) / F.greatest(small, F.lit(1))))
    first = F.col("shard") * small + F.least(F.col("shard").cast("long"), more)
    return ranked.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: tuple[str, ...] = ("source", "lang", "size"), bits: int = BITS) -> None:
    """``docs``, whose doc_id tell rows apart, as Parquet below ``path``: a folder shard=n for each shard, its rows in order of slot.

    A shard is a compact region of the dimensions, so the minima and maxima in its files rule it out for most filters. A null doc_id, or one that
    rows share, is an error, as its rows could not be told apart.
    """
    placed = materialize(hilbert_shards(docs, shards, dimensions, bits).select("doc_id", "shard", "slot"))
    unclear = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if not unclear.isEmpty():
        raise ValueError("rows without a doc_id of their own cannot be written to shards")
    joined = docs.drop("shard", "slot").withColumn("doc_id", F.col("doc_id").cast("long")).join(placed, "doc_id")
    joined.repartition("shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
