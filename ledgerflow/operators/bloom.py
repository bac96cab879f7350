"""Which rows of a huge table may have a key of a small one, before anything of the table is shuffled.

A Bloom filter in blocks: a key's hash names a block of ``BITS`` bits and ``MARKS`` places in it. Tasks build their own
bitmaps, which are merged by block; the filter is one small row a block. Its size follows from the number of keys, and it
is broadcast up to ``MOST_BYTES`` only: beyond, the keys are no small side, and a plain join does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.session import cut

#: Bits of a block, fixed by Spark's bitmap functions; keys a block holds on average (some 16 bits a key), and bits a key sets.
BITS, KEYS, MARKS = 32_768, 2_048, 5
MOST_BYTES = 64 << 20


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks).cast("bigint"))


def _places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BITS).cast("bigint")) for i in range(MARKS)]


def build(keys: DataFrame, key: str, number: int) -> DataFrame | None:
    """(block, bits) of some ``number`` keys; None if it would be too large to broadcast."""
    blocks = -(-number // KEYS) or 1
    if blocks * BITS // 8 > MOST_BYTES:
        return None
    marks = keys.where(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*_places(F.col(key)))).alias("place"))
    return marks.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))


def _has(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def may_have(table: DataFrame, key: str, keys: DataFrame, keys_key: str, number: int) -> DataFrame:
    """The rows of ``table`` whose key may be among ``keys``: all that are, and some in a thousand of the others."""
    found = build(keys, keys_key, number)
    if found is None:
        return table
    blocks = -(-number // KEYS) or 1
    # The table's columns stand in one struct, so none can clash with the filter's.
    rows = table.select(F.struct("*").alias("row"), F.col(f"`{key}`").alias("key"))
    met = rows.join(F.broadcast(found), _block(F.col("key"), blocks) == F.col("block"))
    for place in _places(F.col("key")):
        met = met.where(_has(F.col("bits"), place))
    return met.select("row.*")


def taken(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(__key) of ``table`` that ``new`` has too, and few others: what an exact check is then made with."""
    new = cut(new.select(key))
    return may_have(table.select(F.col(key).alias("__key")), "__key", new, key, new.count())
