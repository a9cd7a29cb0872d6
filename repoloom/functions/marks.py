"""A broadcast bitmap of hashed values, by which a scan tells the few rows that may meet a list from all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap per value; of one block, a row; and at most, as powers of two.
BITS_PER_ID, BLOCK_BITS, MOST_BITS = 32, 15, 28


def marked(id_: Column, ids: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """Bits to join by and the condition, true where ``id_`` is among the ``n`` values of the only column of ``ids``, and for a few others.

    Both have the same type; null is a value like others.
    """
    slots = 1 << min(max((BITS_PER_ID * n - 1).bit_length(), BLOCK_BITS), MOST_BITS)
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit(slots - 1))
    block = lambda c: F.shiftright(slot(c), BLOCK_BITS)
    at = lambda c: slot(c).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    own = ids[ids.columns[0]]
    # dealt out by block first: each block is made once, not once a task
    bits = ids.select(block(own).alias("block"), at(own).alias("at")).repartition("block").groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
    byte = F.conv(F.hex(F.substring(bits["bits"], F.shiftright(at(id_), 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.broadcast(bits), (block(id_) == bits["block"]) & (F.getbit(byte, at(id_).bitwiseAND(F.lit(7))) == 1)
