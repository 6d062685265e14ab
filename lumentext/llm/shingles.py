"""Hashes of runs of words or characters, many texts at a time."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words for the leakage search: maximal runs of letters or digits.
WORD = regex.compile(r"[\p{L}\p{N}]+")
_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that leaves no order: the finaliser of splitmix64."""
    x = x + _C3
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to 64-bit hash; bounded."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


def runs_hash(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive tokens of one long array; empty if there are fewer."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = tokens[:n].copy()
    for j in range(1, k):
        h = mix(h) + tokens[j : n + j]
    return mix(h)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have = 1
    while have * 2 <= w:
        a = np.minimum(a[:-have], a[have:]) if len(a) > have else a[:0]
        have *= 2
    if w > have:
        a = np.minimum(a[: -(w - have)], a[w - have :]) if len(a) > w - have else a[:0]
    return a


def starts_inside(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end: positions from which k tokens lie in one text, and the text of each position."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    pos = np.arange(len(owner)) - first[owner] if len(owner) else owner
    ok = pos + k <= lengths[owner] if len(owner) else np.zeros(0, bool)
    return np.flatnonzero(ok), owner


def merged(blocks: DataFrame, add: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: type, fan: int = 64) -> DataFrame:
    """(block, counts) of (block, counts): the arrays of each block added by ``add``, packed by zlib. The rows of a block are merged in a tree, about ``fan`` at a time."""

    def merge(counts: pd.Series) -> bytes:
        total = None
        for c in counts:
            a = np.frombuffer(zlib.decompress(c), kind)
            total = a if total is None else add(total, a)
        return zlib.compress(total.tobytes(), 1)

    fold = F.pandas_udf(merge, T.BinaryType(), F.PandasUDFType.GROUPED_AGG)
    parts, turns = blocks.rdd.getNumPartitions(), fan
    while turns * fan < parts:
        turns *= fan
    blocks = blocks.withColumn("turn", F.spark_partition_id())
    while turns > 1 and parts > fan:
        blocks = blocks.groupBy("block", F.pmod("turn", F.lit(turns)).alias("turn")).agg(fold("counts").alias("counts"))
        turns //= fan
    return blocks.groupBy("block").agg(fold("counts").alias("counts"))
