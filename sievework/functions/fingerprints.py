"""64-bit fingerprints: conversion, distance, and a token-vote fingerprint for text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import tokens

PAIR_OF_BITS = 0x0000000100000001


def from_hex(digits: Column) -> Column:
    """16 hex digits as a signed LONG with the same bits."""
    return F.conv(digits, 16, -10).cast("bigint")


def to_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def text_fingerprints(df: DataFrame, id_col: str, text_col: str, out: str = "phash64") -> DataFrame:
    """(id, fingerprint) per text: each distinct token votes on every bit with the bits of its md5.

    A token's hash is split in two 32-bit lanes, so 32 sums count the set bits of all 64 positions. The
    sums collapse in the map-side aggregate: one row per text is shuffled, not one per token. Texts
    without any token have no row.
    """
    words = df.select(id_col, F.explode(tokens(F.col(text_col))).alias("_t"))
    hashed = words.select(id_col, from_hex(F.substring(F.md5("_t"), 1, 16)).alias("_h"))
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(PAIR_OF_BITS))).alias(f"_s{i}") for i in range(32)]
    votes = hashed.groupBy(id_col).agg(F.count("*").alias("_n"), *sums)

    def bit(count: Column, position: int) -> Column:
        # more set than unset votes: 2 * count > n
        return F.shiftleft((count * 2 > F.col("_n")).cast("bigint"), position)

    bits = [bit(F.col(f"_s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), i) for i in range(32)]
    bits += [bit(F.shiftrightunsigned(f"_s{i}", 32), i + 32) for i in range(32)]
    while len(bits) > 1:  # pairwise, so that the expression stays shallow
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
    return votes.select(id_col, bits[0].alias(out))
