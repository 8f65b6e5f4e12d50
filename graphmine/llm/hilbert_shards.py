"""Sharding along a Hilbert curve, in DataFrame functions only.

Metadata dimensions are quantised to a few bits each; the cell's index on the Hilbert curve orders the rows, and the
order is cut into runs of equal row counts, so that a shard covers a compact box of every dimension and files prune
on several of them.  Within a cell rows are ordered by a hash of their id, and leading bits of that hash slice the cell, so
that a cell with a third of all rows is spread over as many windows as its share needs.  The rank of a row is
the sum of three counts: cells before it, slices before it in its cell, rows before it in its slice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of each dimension, so the table of cells has 2 ** (BITS * dimensions) rows at most, whatever the input.
BITS = 4
#: Rows that a slice is aimed at, and the bounds of the number of slices of a cell.
SLICE_ROWS, LEAST_SLICE_BITS, MOST_SLICE_BITS = 100_000, 8, 20


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """For each (state, octant): the octant's place on the curve and the next state; a state is an entry corner and an axis.

    Built from the Gray code by the usual rule: place = inverse Gray code of the octant after undoing the state's
    reflection and rotation.
    """
    size, full = 1 << n, (1 << n) - 1
    rotl = lambda x, k: ((x << (k % n)) | (x >> (n - k % n))) & full
    rotr = lambda x, k: rotl(x, n - k % n)
    gray = lambda w: w ^ (w >> 1)
    ungray = {gray(w): w for w in range(size)}
    ones = lambda w: ((w ^ (w + 1)).bit_length() - 1)  # noqa: E731  trailing set bits
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    axis = lambda w: 0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % n
    place, after = [], []
    for e in range(size):
        for d in range(n):
            for octant in range(size):
                w = ungray[rotr(octant ^ e, d + 1)]
                place.append(w)
                after.append((e ^ rotl(entry(w), d + 1)) * n + (d + axis(w) + 1) % n)
    return place, after


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Index on the curve of integer coordinates below ``2 ** bits``."""
    n = len(coordinates)
    place, after = curve_tables(n)
    places, afters = (F.array(*map(F.lit, x)) for x in (place, after))
    point = F.array(*(c.cast("long") for c in coordinates))

    def step(state: Column, level: Column) -> Column:
        octant = sum(((F.floor(point[k] / F.pow(F.lit(2.0), level)).cast("long") % 2) * (1 << k) for k in range(n)), F.lit(0).cast("long"))
        at = (state["s"] * (1 << n) + octant).cast("int")
        return F.struct((state["h"] * (1 << n) + F.element_at(places, at + 1)).cast("long").alias("h"), F.element_at(afters, at + 1).cast("long").alias("s"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("s"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["h"]


def by_magnitude(number: Column, bits: int = BITS) -> Column:
    """Quantise a count by its magnitude, two steps to a doubling from 64 on; null and negative numbers go to the first step."""
    step = F.floor(2 * (F.log2(F.greatest(number.cast("double"), F.lit(1.0))) - 6))
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.coalesce(step, F.lit(0)))).cast("long")


def by_hash(value: Column, bits: int = BITS) -> Column:
    """Quantise a category by a hash; null is a value of its own."""
    return F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit("\0"))), F.lit(1 << bits)).cast("long")


def assign(docs: DataFrame, coordinates: list[Column], shards: int, carry: list[Column], id_column: str = "doc_id", bits: int = BITS) -> DataFrame:
    """``carry`` columns plus ``curve`` (index of the cell), ``shard`` and ``slot`` (gapless from 0 in each shard).

    Row counts of shards are at most one apart; with fewer rows than shards some stay empty.  Null metadata have cells
    of their own, a null id hashes as such, and equal rows take neighbouring slots.
    """
    slice_bits = max(LEAST_SLICE_BITS, min(MOST_SLICE_BITS, math.ceil(math.log2(max(1, docs.count()) / SLICE_ROWS + 1))))
    cell = hilbert_index(coordinates, bits)
    key = F.xxhash64(F.col(id_column))
    ranked_by = [cell.alias("curve"), F.shiftrightunsigned(key, 64 - slice_bits).alias("__slice")]
    counts = docs.select(*ranked_by).groupBy("curve", "__slice").agg(F.count("*").alias("__n"))
    in_cell = counts.select("curve", "__slice", (F.sum("__n").over(W.partitionBy("curve").orderBy("__slice")) - F.col("__n")).alias("__slices_before"))
    every = W.orderBy("curve")
    cells = counts.groupBy("curve").agg(F.sum("__n").alias("__n")).select("curve", (F.sum("__n").over(every) - F.col("__n")).alias("__cells_before"), F.sum("__n").over(W.partitionBy(F.lit(0))).alias("__all"))
    starts = in_cell.join(F.broadcast(cells), "curve").select("curve", "__slice", (F.col("__cells_before") + F.col("__slices_before")).alias("__before"), "__all")
    names = [f"__c{k}" for k in range(len(carry))]
    rows = docs.select(*ranked_by, key.alias("__key"), F.col(id_column).alias("__id"), *(c.alias(n) for c, n in zip(carry, names, strict=True)))
    within = W.partitionBy("curve", "__slice").orderBy("__key", "__id", *names)
    ranked = rows.withColumn("__row", F.row_number().over(within) - 1).join(starts, ["curve", "__slice"]).withColumn("__rank", F.col("__before") + F.col("__row"))
    shard = F.expr(f"__rank * {shards} div __all")
    out = ranked.withColumn("shard", shard).withColumn("slot", F.expr(f"__rank - (shard * __all + {shards - 1}) div {shards}"))
    return out.select(*(F.col(n) for n in names), "curve", F.col("shard").cast("int").alias("shard"), "slot")


def document_coordinates() -> list[Column]:
    """Language and source by hash, length by magnitude."""
    return [by_hash(F.col("lang")), by_hash(F.col("source")), by_magnitude(F.col("n_chars"))]


def assign_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per document ``doc_id``, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, ``curve``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    carry = [F.col("doc_id"), (F.octet_length(text) + 1).cast("long"), F.crc32(F.encode(text, "UTF-8"))]
    placed = assign(docs, document_coordinates(), shards, carry)
    return placed.select(
        F.col("__c0").alias("doc_id"), F.col("__c1").alias("size"), F.col("__c2").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write whole rows of ``docs`` below ``path``, one folder for each shard, files in curve order."""
    names = docs.columns
    placed = assign(docs, document_coordinates(), shards, [F.col(c) for c in names])
    rows = placed.select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(names)), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    rows.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot").drop("__slot").write.partitionBy("__shard").parquet(path)
