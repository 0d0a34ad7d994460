"""A Bloom filter of a fixed number of bits over 64-bit hashes, built by a distributed aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Bloom:
    """Two probes for each hash: its low bits, and its high bits."""

    def __init__(self, hashes: DataFrame, column: str | Column, bits: int = 1 << 24) -> None:
        """At most bits / 64 numbers reach the driver, and bits / 8 bytes each executor, whatever the number of hashes."""
        h = F.col(column) if isinstance(column, str) else column
        bit = F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))))
        word = hashes.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
        word = word.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # as columns: rows would be a hundred times as large
        out = np.zeros(bits // 64, np.int64)
        out[word["word"].to_numpy()] = word["mask"].to_numpy()
        self.bits, self.words = bits, out.view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """For uint64 hashes: False only for those that were not put in."""
        out = np.ones(len(hashes), bool)
        for probe in (hashes, hashes >> np.uint64(32)):
            b = probe & np.uint64(self.bits - 1)
            out &= ((self.words[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out
