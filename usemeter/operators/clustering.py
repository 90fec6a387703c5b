"""Tables clustered by a hash of their key, and sketches of keys: reads that touch only what is asked for.

A key has one of ``SLOTS`` slots.  A clustered table is dealt to files by ranges of the slot and sorted by it, so
a row group, and a page in it, holds a narrow range of slots; a filter on the slot, which Spark hands to
Parquet, skips the others.  Which slots are wanted is a set of at most ``SLOTS`` small numbers, however many keys
there are.

A sketch is a Bloom filter with one hash and a bounded number of bits.  It is computed as a scalar subquery and
tested by built-in functions, so it reaches any scan without a join; its false hits end at a later join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = "slot"
SLOTS = 1 << 16
_LISTED, _RANGES = 10, 128  # slots, and ranges of slots, in one pushed filter
SKETCH_BITS = 1 << 23
_PART_BITS = 1 << 15  # of Spark's bitmaps
GROUP_BYTES = 16 << 20


def slot_of(*key: str | Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS)).cast("int")


def write_clustered(
    df: DataFrame, path: str, key: tuple[str, ...], spread_by: tuple[str, ...] = (),
    files: int | None = None, group_bytes: int = GROUP_BYTES,
) -> None:
    """``df`` and its slot as Parquet below ``path``, overwritten, clustered by ``key``.

    Ranges run over the slot and ``spread_by``, so a key that holds much of the table fills files of its
    own.  ``files`` is their number; without it Spark makes as many as the shuffle has partitions worth
    a task.
    """
    slotted = df.withColumn(SLOT, slot_of(*key))
    ranged = slotted.repartitionByRange(*([files] if files else []), SLOT, *key, *spread_by)
    ranged.sortWithinPartitions(SLOT, *key, *spread_by).write.mode("overwrite").option(
        "parquet.block.size", group_bytes
    ).parquet(path)


def wanted_slots(keys: DataFrame, *key: str | Column) -> list[int]:
    """The slots of ``keys``, sorted: at most ``SLOTS`` numbers reach the driver."""
    return sorted(r[0] for r in keys.select(slot_of(*key).alias(SLOT)).distinct().collect())


def in_slots(df: DataFrame, slots: list[int], scans: int = 1) -> DataFrame:
    """The rows of a clustered table in ``slots`` and none of the others; a table without slots as it is.

    Parquet gets a few slots as they are and a few hundred as the ranges between their widest gaps.  Longer
    lists take a scan for each few hundred, up to ``scans``; beyond that they are filtered behind one scan,
    as Spark would hand the list itself to Parquet as one nested condition a slot.
    """
    if SLOT not in df.columns or len(slots) > SLOTS // 2:  # half of all slots: nothing to be skipped
        return df
    if not slots:
        return df.where(F.lit(False))
    size = 4 * _RANGES
    if size < len(slots) <= size * scans:
        parts = [in_slots(df, slots[i : i + size]) for i in range(0, len(slots), size)]
        return reduce(DataFrame.unionByName, parts)
    listed = f"({', '.join(map(str, slots))})"  # as text: quicker than thousands of columns
    if len(slots) <= _LISTED:
        return df.where(F.expr(f"{SLOT} IN {listed}"))
    exact = F.expr(f"{SLOT} + 0 IN {listed}")  # not a plain column, so not pushed
    if len(slots) > size:
        return df.where(exact)
    spans = " OR ".join(
        f"{SLOT} = {a}" if a == b else f"{SLOT} BETWEEN {a} AND {b}" for a, b in slot_ranges(slots, _RANGES)
    )
    whole = f"{SLOT} BETWEEN {slots[0]} AND {slots[-1]}"  # the cheapest test first
    return df.where(F.expr(whole)).where(F.expr(spans)).where(exact)


def slot_ranges(slots: list[int], most: int) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold the sorted ``slots``, split at the widest gaps."""
    gaps = sorted(range(1, len(slots)), key=lambda i: slots[i] - slots[i - 1], reverse=True)
    cuts = [0, *sorted(i for i in gaps[: most - 1] if slots[i] - slots[i - 1] > 1), len(slots)]
    return [(slots[a], slots[b - 1]) for a, b in zip(cuts, cuts[1:])]


def sketch_bits(n: int, most: int = SKETCH_BITS) -> int:
    """Bits for ``n`` keys at few false hits, a power of two of at most ``most``."""
    bits = _PART_BITS
    while bits < min(32 * n, most):
        bits *= 2
    return bits


def _bit(key: tuple[str | Column, ...], bits: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bits)) + 1


def sketch_rows(keys: DataFrame, *key: str | Column, bits: int = SKETCH_BITS) -> DataFrame:
    """The parts of a sketch of ``keys`` that are not all zero: at most ``bits / 32768`` rows ``n, words``."""
    bit = _bit(key, bits)
    parts = keys.groupBy(F.bitmap_bucket_number(bit).alias("n")).agg(
        F.hex(F.bitmap_construct_agg(F.bitmap_bit_position(bit))).alias("hex")
    )
    word = lambda i: F.conv(F.substring("hex", i * 16 + 1, F.lit(16)), 16, -10).cast("bigint")
    return parts.select("n", F.transform(F.sequence(F.lit(0), F.lit(_PART_BITS // 64 - 1)), word).alias("words"))


def sketch_of(rows: DataFrame, bits: int = SKETCH_BITS) -> Column:
    """The parts put together in their order: an array of ``bits / 64`` words, as a scalar subquery."""
    parts = rows.agg(F.map_from_entries(F.collect_list(F.struct("n", "words"))).alias("m"))
    numbers = F.sequence(F.lit(1).cast("bigint"), F.lit(bits // _PART_BITS).cast("bigint"))
    zeros = F.array_repeat(F.lit(0).cast("bigint"), _PART_BITS // 64)
    whole = F.flatten(F.transform(numbers, lambda n: F.coalesce(F.try_element_at("m", n), zeros)))
    return parts.select(whole).scalar()


def sketch(keys: DataFrame, *key: str | Column, bits: int = SKETCH_BITS) -> Column:
    """A Bloom filter of ``keys``, an array of ``bits / 64`` words, as a scalar subquery."""
    return sketch_of(sketch_rows(keys, *key, bits=bits), bits)


def may_hold(held: Column, *key: str | Column, bits: int = SKETCH_BITS) -> Column:
    """Whether the key may be among those of the sketch ``held``; never false for one that is."""
    bit = _bit(key, bits) - 1
    word = F.get(held, F.shiftright(bit, 6).cast("int"))
    # Bitmaps count bits from the first byte on; a word's first byte is its highest.
    place = (7 - F.shiftright(bit, 3) % 8) * 8 + bit % 8
    return F.getbit(word, place.cast("int")) == 1
