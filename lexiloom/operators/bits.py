"""Bit streams: rows (stream, position, bit) and their codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode_chunks(bits: DataFrame, by: list[str], pos: str, bit: str, width: int, offset: int = 0, reverse: bool = False, invert: bool = False, first: int = 97, letters: int = 26) -> DataFrame:
    """(by, decoded): full chunks of `width` bits as letters from code point `first`; values beyond the alphabet are '?'. ASCII: width 7 or 8, first 0, letters 128."""
    at = F.col(pos) - offset
    place = at % width if reverse else (width - 1) - at % width
    b = (1 - F.col(bit)) if invert else F.col(bit)
    c = bits.where(F.col(pos) >= offset).groupBy(*by, F.floor(at / width).alias("chunk")).agg(F.sum(b * F.pow(F.lit(2), place).cast("int")).cast("int").alias("v"), F.count("*").alias("n")).where(F.col("n") == width)
    letter = F.when(F.col("v") < letters, F.char(F.col("v") + first)).otherwise("?")
    return c.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", letter.alias("x")))), lambda s: s["x"]), "").alias("decoded"))


def encode_bits(text, width: int = 5):
    """Bits of a lower-case text, `width` to a letter, as an array column."""
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    return F.flatten(F.transform(letters, lambda x: F.transform(F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1)), lambda k: (F.floor((F.ascii(x) - 97) / F.pow(F.lit(2.0), k)) % 2).cast('int'))))
