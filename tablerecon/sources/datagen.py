"""Rows in the likeness of a table, for load tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerecon.functions.names import col

# What generated columns are filled with.
VALUES = ("A", "B", "C", "D", "E")


_ROUNDS = 4


def permuted(number: Column, bits: int, seed: int) -> Column:
    """A keyed one-to-one shuffle of the numbers below ``2 ** (2 * bits)``: a Feistel network of hashes."""
    half = F.lit((1 << bits) - 1)
    left, right = F.shiftrightunsigned(number, bits), number.bitwiseAND(half)
    state = F.struct(left.alias("l"), right.alias("r"))
    for i in range(_ROUNDS):
        # A lambda holds each half in one place; as plain columns the rounds would double in size.
        mixed = lambda x, i=i: x["l"].bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(i), x["r"]).bitwiseAND(half))
        state = F.get(F.transform(F.array(state), lambda x: F.struct(x["r"].alias("l"), mixed(x).alias("r"))), F.lit(0))
    return F.get(F.transform(F.array(state), lambda x: F.shiftleft(x["l"], bits).bitwiseOR(x["r"])), F.lit(0))


def generate_like(df: DataFrame, key: str, total: int | None = None, seed: int = 0, times: int | None = None) -> DataFrame:
    """Grow a table to ``total`` rows, or ``times`` its own number: its rows, and new ones with unused keys.

    New keys are distinct by construction: a row number is shuffled one-to-one
    and written in one digit more than the longest key in use has characters,
    so that none can be taken.  Number of rows and longest key come from one
    aggregate.  Keys and values depend on the seed and the row number only, so
    a rerun of a lost task makes the same rows.
    """
    if (total is None) == (times is None):
        raise ValueError("give either a total or a number of times")
    longest = F.coalesce(F.max(F.char_length(col(key).cast("string"))), F.lit(0))
    rows, length = df.agg(F.count(F.lit(1)), longest).first()
    missing = max((rows * times if total is None else total) - rows, 0)
    bits = max(16, -(-max(missing - 1, 1).bit_length() // 2))
    digits = max(length + 1, -(-2 * bits // 4))
    letters = F.array(*[F.lit(v) for v in VALUES])

    def pick(name: str) -> Column:
        slot = F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id"), F.lit(len(VALUES))).cast("int")
        return F.get(letters, slot).alias(name)

    fresh = F.lpad(F.hex(permuted(F.col("id"), bits, seed)), digits, "0").alias(key)
    made = df.sparkSession.range(missing).select(*[fresh if c == key else pick(c) for c in df.columns])
    return df.select(*[col(c).cast("string").alias(c) for c in df.columns]).unionByName(made)
