"""Array expressions over word hashes, built of DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shifted(df: DataFrame, name: str, by: int, combine: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """out: combine(a[i], a[i + by]) for each i that has both."""
    count = F.greatest(F.size(name) - by, F.lit(0))
    return df.withColumn(out, F.zip_with(F.slice(name, F.lit(1), count), F.slice(name, F.lit(by + 1), count), combine))


def grams(df: DataFrame, hashes: str, size: int, out: str) -> DataFrame:
    """out: a hash of each size consecutive elements, by doubling."""
    return several_grams(df, hashes, {out: size})


def several_grams(df: DataFrame, hashes: str, sizes: dict[str, int]) -> DataFrame:
    """For each name of sizes a hash of each so many consecutive elements; what sizes have in common is made once."""
    columns = df.columns
    made = {1: hashes}

    def joined(df: DataFrame, first: int, second: int) -> DataFrame:
        """Hashes of first and then second elements, both of which are there."""
        if first + second in made:
            return df
        made[first + second] = f"_g{first + second}"
        count = F.greatest(F.size(hashes) - (first + second - 1), F.lit(0))
        both = F.zip_with(F.slice(made[first], F.lit(1), count), F.slice(made[second], F.lit(first + 1), count), lambda x, y: F.xxhash64(x, y))
        return df.withColumn(made[first + second], both)

    for size in sizes.values():
        length = 1
        while 2 * length <= size:
            df = joined(df, length, length)
            length *= 2
        powers = [1 << i for i in range(length.bit_length())]
        while length < size:
            part = max(n for n in powers if n <= size - length)
            df = joined(df, length, part)
            length += part
    return df.select(*[c for c in columns if c not in sizes], *[F.col(made[size]).alias(out) for out, size in sizes.items()])


def sliding_least(df: DataFrame, values: str, width: int, out: str) -> DataFrame:
    """out: the least of each width consecutive elements."""
    columns = df.columns
    have, length = values, 1
    while length < width:
        by = min(length, width - length)
        df = shifted(df, have, by, lambda x, y: F.least(x, y), f"_m{length + by}")
        length += by
        have = f"_m{length}"
    return df.withColumn(out, F.col(have)).select(*[c for c in columns if c != out], out)
