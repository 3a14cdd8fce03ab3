"""Key membership without a shuffle: a bitmap of hashed keys, broadcast.

Joining whole files with a large set of places would move every file through
an exchange.  The set is hashed into a bitmap first (one bit a key, Spark's
bitmap aggregates, at most ``MAX_BITS`` bits = 32 MB whatever the set), and
rows whose bit is not set are dropped where they are read.  A row that stays
may still be a false positive: callers join or filter exactly afterwards, on
what is left or on narrow rows derived from it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 28            # 2**28 bits, 32 MB; beyond some 1e8 keys the bitmap fills up and lets more rows pass
MIN_BITS = 15            # one bucket of Spark's bitmap functions
SPREAD = 32              # bits a key while there is room: 3 % of other rows pass


def _slot(cols: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << bits)) + 1


def key_bitmap(keys: DataFrame, cols: list[str], count: int) -> tuple[DataFrame, int]:
    """(bucket, bits) rows of 4 KB, and the width; ``count``: about how many
    keys there are."""
    width = max(MIN_BITS, min(MAX_BITS, math.ceil(math.log2(max(count, 1) * SPREAD))))
    slot = _slot(cols, width)
    return (keys.select(F.bitmap_bucket_number(slot).alias("_bucket"), F.bitmap_bit_position(slot).alias("_at"))
            .groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))), width


def may_hold(df: DataFrame, bitmap: tuple[DataFrame, int], cols: list[str]) -> DataFrame:
    """Rows of ``df`` whose key may be in the set: none that is in it is lost."""
    table, width = bitmap
    slot = _slot(cols, width)
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST(_at DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    marked = df.withColumns({"_bucket": F.bitmap_bucket_number(slot), "_at": F.bitmap_bit_position(slot)})
    return (marked.join(F.broadcast(table), "_bucket")
            .where(byte.bitwiseAND(F.expr("shiftleft(1, CAST(_at % 8 AS INT))")) != 0).select(*df.columns))
