"""Joins and membership tests that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when its rows are more than 1 in so many of all. As the counts of
#: different keys add up to all rows at most, there are at most so many hot keys,
#: whatever the input's size: that bounds what is broadcast.
HOT_SHARE = 1000

#: Bits of a membership filter, and so 2 MB of them to broadcast at any input size.
FILTER_BITS = 1 << 24


def join_group(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``groups``, which has one row for each key and counts its rows in column ``n``.

    Rows of hot keys meet their group by a broadcast of the hot groups, at most
    ``HOT_SHARE`` of them; all other rows by a shuffle in which no key has more
    than 1 in ``HOT_SHARE`` of the rows. ``how``: ``left`` or ``inner``.
    Keys must not be null.
    """
    is_hot = F.col(n) * F.lit(HOT_SHARE) > F.lit(int(total))
    hot = groups.where(is_hot)
    cold = groups.where(~is_hot)
    with_hot = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return with_hot.unionByName(rest.join(cold, keys, how).select(*with_hot.columns))


def filter_of(keys: DataFrame, slot: Column) -> DataFrame:
    """A bit filter of a fixed size over ``slot``, a hash of the key of each row of ``keys``.

    Like a Bloom filter with one hash function: no member is missed, and other
    keys pass by chance, more of them the fuller it is.
    """
    at = F.pmod(slot, F.lit(FILTER_BITS)) + F.lit(1)
    return keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))


def maybe_member(rows: DataFrame, members: DataFrame, slot: Column, name: str) -> DataFrame:
    """``rows`` with boolean ``name``: false only where ``slot`` isn't in the filter."""
    at = F.pmod(slot, F.lit(FILTER_BITS)) + F.lit(1)
    joined = rows.withColumn("_at", at).withColumn("_bucket", F.bitmap_bucket_number("_at")).join(F.broadcast(members), "_bucket", "left")
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.expr("cast(bitmap_bit_position(_at) div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    mask = F.pow(F.lit(2), bit % 8).cast("int")
    return joined.withColumn(name, F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))).select(*rows.columns, name)
