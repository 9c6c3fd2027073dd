"""Which ids are stored already: Bloom filters answer for nearly all of them, stored ids for the rest.

A filter is a table of blocks of 2^15 bits. An id's hash picks a block and four bits in it, so that looking an id up
needs one block. The number of blocks is a power of two that fits the number of ids; an id that no filter knows is new
for certain. Those that a filter may know are looked up among the stored ids, which a large layer keeps in PARTS
folders by hash: only folders of such ids are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block, as bitmap_construct_agg has them; how many an id sets; ids a block is meant for (about 10 bits each).
BLOCK_BITS, SET_BITS, IDS_PER_BLOCK = 1 << 15, 4, 3200
#: Folders of a layer's ids; up to so many ids are in one, of the name WHOLE.
PARTS, SMALL, WHOLE = 64, 100_000, -1


def n_blocks(n_ids: int) -> int:
    """The least power of two that gives each block at most IDS_PER_BLOCK ids on average."""
    return 1 << max(0, (-(-n_ids // IDS_PER_BLOCK) - 1).bit_length())


def hashed(rows: DataFrame) -> DataFrame:
    """id, h"""
    return rows.select("id", F.xxhash64("id").alias("h"))


def _block(blocks: int | Column) -> Column:
    # the part of the hash that folders go by isn't used again
    size = F.lit(blocks).cast("long") if isinstance(blocks, int) else blocks
    return F.pmod(F.shiftright("h", 8), size)


def _bits() -> Column:
    """Places in the block, from a second hash."""
    other = F.xxhash64("h", F.lit(1))
    return F.array(*[F.shiftrightunsigned(other, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(SET_BITS)])


def filter_of(rows: DataFrame, blocks: int) -> DataFrame:
    """n_blocks, block, bits: the filter of the ids in `rows`; blocks without ids have no row."""
    # ids cross the shuffle, not each task's bits of all blocks, of which there would be tasks x blocks
    dealt = hashed(rows).select(_block(blocks).alias("block"), "h").repartition("block")
    # a bitmap for each of an id's bits, put together block by block: the aggregate sorts its rows, so it gets one an id
    apart = dealt.groupBy("block").agg(F.array(*[F.bitmap_construct_agg(_bits()[i]) for i in range(SET_BITS)]).alias("maps"))
    bits = apart.select("block", F.explode("maps").alias("map")).groupBy("block").agg(F.bitmap_or_agg("map").alias("bits"))
    return bits.select(F.lit(blocks).cast("long").alias("n_blocks"), "block", "bits")


def write_ids(rows: DataFrame, path: str, layer: bool, n_ids: int) -> None:
    """The ids with their hashes; a large layer's in folders."""
    ids = hashed(rows)
    if layer and n_ids > SMALL:
        part = F.pmod("h", F.lit(PARTS)).cast("int")
        ids.withColumn("part", part).repartition(PARTS, "part").sortWithinPartitions("part", "h").write.mode("overwrite").partitionBy("part").parquet(path)
    elif layer:
        ids.withColumn("part", F.lit(WHOLE)).coalesce(1).write.mode("overwrite").partitionBy("part").parquet(path)
    else:
        ids.write.mode("overwrite").parquet(path)


def may_be_known(ids: DataFrame, filters: DataFrame, sizes: list[int]) -> DataFrame:
    """The rows of `ids` (id, h) for which some filter has all bits; `sizes` are the numbers of blocks that filters have.

    An id is asked for once per size, as filters of one size are put together block by block (only the blocks that
    ids fall in).
    """
    asked = ids.select("id", "h", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])).alias("n_blocks"))
    asked = asked.select("id", "h", "n_blocks", _block(F.col("n_blocks")).alias("block"), _bits().alias("places"))
    byte = lambda bits, p: F.conv(F.hex(F.substring(bits, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = lambda bits, p: F.call_function("getbit", byte(bits, p), p.bitwiseAND(F.lit(7)).cast("int"))
    met = asked.join(filters.select("n_blocks", "block", "bits"), ["n_blocks", "block"])
    return met.where(F.forall("places", lambda p: bit(F.col("bits"), p) == 1)).select("id", "h").distinct()


def unseen(rows: DataFrame, filters: DataFrame, sizes: list[int], ids: DataFrame, layer_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose id is stored nowhere, and a persisted frame to let go when they are written.

    `filters` are those of all stored ids; `layer_ids` has its folder as `part`.
    """
    maybe = may_be_known(hashed(rows), filters, sizes).persist()
    # at most PARTS numbers come to the driver; folders without such ids aren't read
    parts = [r[0] for r in maybe.select(F.pmod("h", F.lit(PARTS)).cast("int").alias("part")).distinct().collect()]
    if not parts:
        return rows, maybe
    stored = ids.select("id", "h").unionByName(layer_ids.where(F.col("part").isin([WHOLE, *parts])).select("id", "h"))
    known = maybe.join(stored, ["id", "h"], "left_semi").select("id")
    return rows.join(known, "id", "left_anti").select(rows.columns), maybe
