"""A set of values as a bitmap, so that a join on a column of which few values are in the set shuffles only rows that may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

BITS_PER_VALUE = 8
#: 32 MB; beyond, a bitmap clears fewer rows.
MOST_BITS = 1 << 28
#: Bits in a row of the bitmap, as ``bitmap_construct_agg`` makes it.
ROW_BITS = 1 << 15


def _place(column: str, size: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(size))


def split_by_bitmap(df: DataFrame, column: str, values: DataFrame, among: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (``among`` those asked for) whose ``column`` may be in the one column of ``values``, and all other rows.

    Rows with a value of the set are all in the first part; a few others are there too.  ``values`` is read twice.
    """
    size, wanted = ROW_BITS, values.count() * BITS_PER_VALUE
    while size < min(MOST_BITS, wanted):
        size <<= 1
    at = _place(values.columns[0], size)
    rows = values.select(F.shiftright(at, 15).alias("_part"), at.bitwiseAND(ROW_BITS - 1).alias("_bit")).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    words = F.expr("transform(sequence(0, 511), i -> CAST(conv(hex(substring(_bits, i * 8 + 1, 8)), 16, -10) AS BIGINT))")
    held = F.broadcast(cut(rows.select("_part", words.alias("_words"))))
    own = _place(column, size)
    bit = own.bitwiseAND(ROW_BITS - 1).cast("int")
    # a word's first byte is its highest, a byte's first bit its lowest
    shift = F.lit(56) - F.shiftright(bit, 3).bitwiseAND(7) * 8 + bit.bitwiseAND(7)
    inside = among & F.coalesce(F.getbit(F.get("_words", F.shiftright(bit, 6)), shift) == 1, F.lit(False))
    met = df.join(held, F.shiftright(own, 15) == held["_part"], "left")
    return met.where(inside).select(*df.columns), met.where(~inside).select(*df.columns)
