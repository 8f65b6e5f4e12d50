"""Line dedup: fuzzy lines by MinHash; signatures and verification in Arrow batches, all else in DataFrame functions.

Every line with a visible character is named by a hash, and equal lines are one from the first shuffle on.  A line is the set of its
character 5-shingles, taken at all positions; a shorter line is one shingle.  ``BANDS`` * ``ROWS`` minima sign it, each under a hash of its own.

Lines that agree in a band are tied to the least line of that band: at first each line to the least of these alone, then to those of the bands where it
is still in another component, so that a crowd of near copies makes one tie a line and not one a band; and there to the least of such lines in the band as well.
A tie is verified by the exact Jaccard of the lines' shingle sets, unless their sketches (four bits of a minimum) agree in fewer than five places
of eight (true links do that once in a thousand times at the threshold itself, and hardly ever above it), or their maps (parities of parts of
the set) differ in more bits than linked sets can, which loses none.  What is still apart then is compared in full: each member of a band outside the
band's largest component with every member of another component, by sketch and map and then by the exact Jaccard.  The time of that grows with the product
of the two; rows are made of the alike pairs alone.  Components of verified ties (union-find by star steps) keep one line: the first in the document with the least id.

A worker holds the shingles of ``CHARACTERS`` characters, or of one longer line, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmine.llm import runtime
from graphmine.llm.components import components

#: Documented parameters: shingle length, least Jaccard in hundredths, bands and minima of a band.
SHINGLE, THRESHOLD, BANDS, ROWS = 5, 80, 10, 5
#: Longs of a sketch, 16 minima each; places that must agree for a verification.
SKETCH, LEAST_AGREED = 3, 30
#: Longs of a map of parities (a power of two).
MAP = 16
#: Names of lines that a worker knows as signed before it forgets them.
KNOWN = 1 << 17
#: Characters that are hashed at once.
CHARACTERS = 1 << 16
#: Keys with at least one part in this of all rows are joined by a broadcast; there are at most so many.
HEAVY = 2_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit or 32-bit numbers in which every bit depends on all."""
    kind = x.dtype.type
    if kind is np.uint32:
        x = (x ^ x >> kind(16)) * kind(0x85EBCA6B)
        x = (x ^ x >> kind(13)) * kind(0xC2B2AE35)
        return x ^ x >> kind(16)
    x = (x ^ x >> kind(30)) * kind(0xBF58476D1CE4E5B9)
    x = (x ^ x >> kind(27)) * kind(0x94D049BB133111EB)
    return x ^ x >> kind(31)


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers: multiples of the golden ratio, mixed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_OF_PLACE, _OF_MINIMUM = constants(SHINGLE, 0), constants(BANDS * ROWS, 1 << 20).astype(np.uint32)


def shingles(lines: list[str], kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles at all positions, line after line, and how many each line has (one at least).  No line holds a line feed."""
    end = "\n" * SHINGLE
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer((end.join(lines) + end).encode("utf-32-le", "surrogatepass"), np.uint32).astype(kind)
    windows = len(codes) - SHINGLE + 1
    total = codes[:windows] * kind(_OF_PLACE[0] & np.uint64(np.iinfo(kind).max))
    for k in range(1, SHINGLE):
        total += codes[k : k + windows] * kind(_OF_PLACE[k] & np.uint64(np.iinfo(kind).max))
    counts = np.maximum(lengths - (SHINGLE - 1), 1)
    after = np.cumsum(lengths + SHINGLE)
    past = after - lengths - SHINGLE + counts
    whole = np.ones(len(codes), bool)
    for k in range(2 * SHINGLE - 1):
        whole[np.minimum(past + k, after - 1)] = False
    return mix(total[whole[:windows]]), counts


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each line its bands (rows of a matrix) and its sketch."""
    hashes, counts = shingles(lines, np.uint32)
    first = np.cumsum(counts) - counts
    bands = np.empty((len(lines), BANDS), np.uint64)
    sketch = np.zeros((len(lines), SKETCH), np.uint64)
    turned = np.empty_like(hashes)
    for k, by in enumerate(_OF_MINIMUM):
        np.multiply(hashes, by, out=turned)
        least = mix(np.minimum.reduceat(turned, first).astype(np.uint64))
        band, row = divmod(k, ROWS)
        bands[:, band] = mix((bands[:, band] if row else np.uint64(band + 1)) + least)
        if k < 16 * SKETCH:
            sketch[:, k // 16] |= (least & np.uint64(15)) << np.uint64(4 * (k % 16))
    return bands, sketch


def shingle_sets(lines: list[str]) -> tuple[np.ndarray, int]:
    """Sorted distinct numbers, each a line's position before the leading bits (so many) of a shingle's hash."""
    bits = 64 - len(lines).bit_length()
    hashes, counts = shingles(lines)
    named = np.sort(np.repeat(np.arange(len(lines), dtype=np.uint64), counts) << np.uint64(bits) | hashes >> np.uint64(64 - bits))
    return named[np.append(True, named[1:] != named[:-1])], bits


def parity_maps(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each line the size of its shingle set, and for each of 64 * ``MAP`` parts of the hashes' range whether the set has an odd number there.

    Two maps differ in as many bits as the sets' symmetric difference has elements, or in fewer.
    """
    sets, bits = shingle_sets(lines)
    row, wide = (sets >> np.uint64(bits)).astype(np.int64), 64 * MAP
    place = (sets >> np.uint64(bits - (wide.bit_length() - 1))).astype(np.int64) & (wide - 1)
    odd = (np.bincount(row * wide + place, minlength=len(lines) * wide) & 1).astype(np.uint8)
    return np.bincount(row, minlength=len(lines)), np.packbits(odd.reshape(len(lines), wide), axis=1, bitorder="little").view(np.int64)


def jaccard_counts(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of lines the sizes of the intersection and of the union of their shingle sets."""
    n = len(left)
    sets, bits = zip(*map(shingle_sets, (left, right)), strict=True)
    position = np.uint64(bits[0])
    sizes = [np.bincount((x >> position).astype(np.int64), minlength=n) for x in sets]
    met = np.sort(np.concatenate(sets))
    both = np.bincount((met[1:][met[1:] == met[:-1]] >> position).astype(np.int64), minlength=n)
    return both, sizes[0] + sizes[1] - both


def _runs(sizes: list[int]) -> Iterator[slice]:
    """Runs of items whose sizes make up ``CHARACTERS``, or of one item."""
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > CHARACTERS:
            yield slice(start, k)
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: set[int] = set()
    for batch in batches:
        new = []
        for k, name in enumerate(batch.column(0).to_pylist()):
            if name not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known.add(name)
                new.append(k)
        batch = batch.take(pa.array(new, pa.int32()))
        names, lines = batch.column(0), batch.column(1).to_pylist()
        for run in _runs([len(x) + SHINGLE for x in lines]):
            bands, sketch = signatures(lines[run])
            ends = pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32())
            columns = [names[run.start : run.stop], pa.ListArray.from_arrays(ends, pa.array(bands.ravel().view(np.int64)))]
            columns += [pa.array(np.ascontiguousarray(sketch[:, k]).view(np.int64)) for k in range(SKETCH)]
            yield pa.RecordBatch.from_arrays(columns, ["name", "bands", *(f"k{k}" for k in range(SKETCH))])


def _map_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = batch.column(1).to_pylist()
        for run in _runs([len(x) + SHINGLE for x in lines]):
            sizes, maps = parity_maps(lines[run])
            columns = [x.slice(run.start, run.stop - run.start) for x in batch.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(MAP))], [*batch.schema.names, "n", *(f"w{k}" for k in range(MAP))])


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for run in _runs([len(x) + len(y) + 2 * SHINGLE for x, y in zip(left, right, strict=True)]):
            both, either = jaccard_counts(left[run], right[run])
            linked = pa.array(100 * both >= THRESHOLD * either)
            yield pa.RecordBatch.from_arrays([batch.column(k)[run.start : run.stop].filter(linked) for k in (0, 1)], ["a", "b"])


def lines_of(docs: DataFrame, text: str, *carry: Column) -> DataFrame:
    """``carry`` columns, ``place`` (from 0) and ``line`` of every line with a visible character."""
    return docs.select(*carry, F.posexplode(F.split(F.col(text), "\n", -1)).alias("place", "line")).where(F.col("line").rlike(r"\S"))


def line_name(line: Column) -> Column:
    return F.xxhash64(line)


def distinct_lines(docs: DataFrame, text: str) -> DataFrame:
    """``name, line`` of all distinct lines, dealt by name."""
    return lines_of(docs, text).select(line_name(F.col("line")).alias("name"), "line").dropDuplicates(["name"])


def alike_enough() -> Column:
    """Whether enough places of the sketches of ``a`` and ``b`` agree, and their maps differ in no more bits than linked sets can."""
    total = F.lit(16 * SKETCH)
    for word in range(SKETCH):
        x = F.col(f"a_k{word}").bitwiseXOR(F.col(f"b_k{word}"))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        total = total - F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    apart = sum((F.bit_count(F.col(f"a_w{word}").bitwiseXOR(F.col(f"b_w{word}"))) for word in range(MAP)), F.lit(0))
    return (total >= LEAST_AGREED) & ((100 + THRESHOLD) * apart <= (100 - THRESHOLD) * (F.col("a_n") + F.col("b_n")))


#: What a pair is judged by before it is verified.
JUDGED = [*(f"k{w}" for w in range(SKETCH)), "n", *(f"w{w}" for w in range(MAP))]


def signed_lines(docs: DataFrame, text: str) -> DataFrame:
    """``name``, ``bands`` and sketch of all lines; a line that a worker has forgotten comes again."""
    runtime.ship(docs.sparkSession)
    lines = lines_of(docs, text).select(line_name(F.col("line")).alias("name"), "line")
    return lines.mapInArrow(_sign_batches, "name long, bands array<long>, " + ", ".join(f"k{k} long" for k in range(SKETCH)))


def members_of(signed: DataFrame) -> DataFrame:
    """``band, name, least`` of all bands with two lines or more."""
    dealt = signed.select("name", F.explode("bands").alias("band")).repartition("band")
    least = dealt.groupBy("band").agg(F.min("name").alias("least"), F.max("name").alias("top")).where("least < top").select("band", "least").hint("shuffle_hash")
    return dealt.join(least, "band").select("band", "name", "least").distinct()


def members_lines(docs: DataFrame, text: str, members: DataFrame, signed: DataFrame) -> DataFrame:
    """``name, line``, sketch, set size and map of the lines that share a band with another."""
    wanted = members.select("name").distinct()
    sketches = signed.join(wanted.hint("shuffle_hash"), "name", "left_semi").select("name", *JUDGED[:SKETCH]).dropDuplicates(["name"])
    lines = distinct_lines(docs, text).join(sketches.hint("shuffle_hash"), "name").select("name", "line", *JUDGED[:SKETCH])
    runtime.ship(docs.sparkSession)
    return lines.mapInArrow(_map_batches, "name long, line string, " + ", ".join(f"{k} long" for k in JUDGED))


def first_ties(members: DataFrame) -> DataFrame:
    """For each member the least of its bands' least lines, as ``members`` of one band a line."""
    return members.where("name <> least").groupBy("name").agg(F.min("least").alias("least"))


def alike(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct pairs ``a, b`` of a member of a band and its least line that are alike enough."""
    pairs = members.where("name <> least").select(F.col("name").alias("a"), F.col("least").alias("b")).distinct()
    one, two = (texts.select(F.col("name").alias(n), *(F.col(k).alias(f"{n}_{k}") for k in JUDGED)) for n in "ab")
    return pairs.join(two.hint("shuffle_hash"), "b").join(one.hint("shuffle_hash"), "a").where(alike_enough()).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose lines' shingle sets have Jaccard ``THRESHOLD`` or more."""
    left, right = (texts.select(F.col("name").alias(n), F.col("line").alias(f"line_{n}")) for n in "ab")
    # the side that many pairs share is joined first, where rows are numbers; the other deals them evenly
    sets = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "line_a", "line_b")
    runtime.ship(pairs.sparkSession)
    return sets.mapInArrow(_verify_batches, "a long, b long")


def unmet(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members of bands in another component than the least of their band."""
    one, two = (label.select(F.col("node").alias(n), F.col("component").alias(f"__{n}")) for n in ("name", "least"))
    return members.join(one, "name", "left").join(two, "least", "left").where(F.coalesce("__name", "name") != F.coalesce("__least", "least")).select("band", "name", "least")


def second_ties(left: DataFrame) -> DataFrame:
    """``left`` (of ``unmet``), and its members with the least of them in their band as ``least``."""
    least = left.groupBy("band").agg(F.min("name").alias("least"))
    return left.unionByName(left.select("band", "name").join(least, "band").select("band", "name", "least"))


def apart(members: DataFrame, label: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct pairs ``a, b`` of members of one band in different components that are alike enough.

    Compared are members outside their band's largest component with members of it, so a crowd that is one component takes no time; rows are
    made of alike pairs only.
    """
    part = label.select(F.col("node").alias("name"), F.col("component").alias("__part"))
    placed = members.select("band", "name").join(part, "name", "left").select("band", "name", F.coalesce("__part", "name").alias("part"))
    tally = placed.groupBy("band", "part").agg(F.count("*").alias("n")).groupBy("band")
    main = tally.agg(F.max(F.struct("n", "part")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("band", F.col("top.part").alias("main"))
    some = placed.join(main, "band").join(texts.select("name", *JUDGED), "name")
    one, two = (some.select("band", F.col("name").alias(n), F.col("part").alias(f"part_{n}"), (F.col("part") != F.col("main")).alias(f"minor_{n}"), *(F.col(k).alias(f"{n}_{k}") for k in JUDGED)) for n in "ab")
    met = one.where("minor_a").join(two, "band").where("part_a <> part_b and (not minor_b or a > b)")
    return met.where(alike_enough()).select("a", "b").distinct()


def _join_heavy(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join on a key that is unique in ``right``; keys that weigh much are broadcast, so that no task gets all rows of one."""
    heavy = F.col(weight) * HEAVY >= total
    return left.join(F.broadcast(right.where(heavy).drop(weight)), key).unionByName(left.join(right.where(~heavy).drop(weight), key))


def dropped_lines(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``__id``, ``__hash`` (of the text) and ``__drop`` (places of lines to drop) of the documents that lose lines."""
    keep = runtime.materialize
    signed = keep(signed_lines(docs, text), "line-signatures")
    members = keep(members_of(signed), "line-members")
    texts = keep(members_lines(docs, text, members, signed), "line-texts")
    runtime.drop_tables([signed])

    written = [members, texts]
    label: DataFrame | None = None
    for tied in (
        lambda: alike(first_ties(members), texts),
        lambda: alike(second_ties(unmet(members, label)), texts),
        lambda: apart(members, label, texts),
    ):
        ties = keep(tied(), "line-ties")
        found = keep(verified(ties, texts), "line-links")
        written += [ties, found]
        before, links = label, found
        if before is not None:
            links = found.unionByName(before.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        label = components(links)
        if before is not None:
            runtime.drop_tables([before])
    runtime.drop_tables(written)

    named = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    occurrences = keep(lines_of(named, "text", F.col("id"), F.col("hash")).select("id", "hash", "place", line_name(F.col("line")).alias("name")), "line-table")

    # without a null id first: a document with an id is kept before one without
    order = F.coalesce(F.col("id"), F.lit((1 << 63) - 1))
    counts = occurrences.groupBy("name").agg(F.count("*").alias("n"), F.min(order).alias("first_id"))
    groups = keep(counts.join(label.withColumnRenamed("node", "name"), "name", "left").select("name", F.coalesce("component", "name").alias("group"), "n", "first_id"), "line-names")
    sizes = keep(groups.groupBy("group").agg(F.sum("n").alias("all"), F.min("first_id").alias("first_id")).where("all > 1"), "line-groups")
    total = occurrences.count()
    several = keep(_join_heavy(groups.select("group", "name", "n"), sizes, "group", "all", total), "line-several")
    places = keep(_join_heavy(occurrences, several, "name", "n", total).select("group", "id", "hash", "place", (order == F.col("first_id")).alias("first")), "line-places")
    stay = places.where("first").groupBy("group").agg(F.min(F.struct("hash", "place")).alias("k")).select("group", F.col("k.hash").alias("keep_hash"), F.col("k.place").alias("keep_place"))
    rest = places.where("first").join(stay, "group").where(~((F.col("hash") == F.col("keep_hash")) & (F.col("place") == F.col("keep_place"))))
    away = places.where("not first").select("id", "hash", "place").unionByName(rest.select("id", "hash", "place"))
    gone = keep(away.groupBy(F.col("id").alias("__id"), F.col("hash").alias("__hash")).agg(F.collect_set("place").alias("__drop")), "line-gone")
    runtime.drop_tables([occurrences, label, groups, sizes, several, places])
    return gone


def dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, its texts without dropped lines, and ``__lines`` and ``__dropped`` (counts).

    Blank lines stay where a line of their text stays.  A null text stays null, with no lines; an empty one stays
    empty.  Rows that repeat an id and text lose the same lines.  A null id counts as larger than any.  Lines are named by 64 bits.
    """
    gone = dropped_lines(docs, id_column, text)
    joined = docs.withColumn("__h", F.xxhash64(text)).join(gone.hint("shuffle_hash"), F.col(id_column).cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")
    drop = F.coalesce(F.col("__drop"), F.array().cast("array<int>"))
    left = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x, k: F.when(~F.array_contains(drop, k), x)), lambda x: x.isNotNull())
    lines = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(r"\S")))
    rest = F.when(F.size(drop) == 0, F.col(text)).when(F.size(drop) >= lines, F.lit("")).otherwise(F.array_join(left, "\n"))
    return joined.select(*(rest.alias(c) if c == text else F.col(c) for c in docs.columns), lines.alias("__lines"), F.size(drop).alias("__dropped"))
