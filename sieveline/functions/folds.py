"""Fold and bucket hashes of keys. The multipliers, seeds and moduli of the hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def poly31(key: Column, folds: int = 3) -> Column:
    """31-multiplier hash from seed 7 over the characters, modulo 2^32, then modulo ``folds``."""
    chars = F.filter(F.split(key, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(7).cast("bigint"), lambda s, c: (s * 31 + F.ascii(c).cast("bigint")).bitwiseAND(F.lit(MASK)))
    return (h % folds).cast("int")


def fnv1a(key: Column) -> Column:
    """32-bit FNV-1a over the characters of the key, as a bigint."""
    chars = F.filter(F.split(key, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("bigint"), lambda s, c: (s.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619).bitwiseAND(F.lit(MASK)))


def fnv_fold(key: Column, folds: int) -> Column:
    return (fnv1a(key) % folds).cast("int")


def split_of(key: Column, train: int = 50, calibration: int = 25, seed: str = "split:") -> Column:
    """train / calibration / test by the md5 of the key, in per cent."""
    b = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(b < train, "train").when(b < train + calibration, "calibration").otherwise("test")


def random_rank(key: Column, seed: int) -> Column:
    """A reproducible random order of keys: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
