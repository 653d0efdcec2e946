"""A filter of fixed size over 64-bit numbers, summed by Spark, for the tasks of a later scan.

Whatever the input, the driver and each task hold 2 ** BITS bits. A number that was put in
always passes; others pass rarely while few are in, and must be told apart by a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import batches as B

B.ship(__name__)

BITS = 26


def _places(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.uint64((1 << BITS) - 1)
    numbers = B.mixed(numbers)
    return (numbers & size).astype(np.int64), ((numbers >> np.uint64(BITS)) & size).astype(np.int64)


class Bitmap:
    """The non-zero 64-bit words of the filter."""

    def __init__(self, words: np.ndarray, bits: np.ndarray):
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Bitmap:
        def run(batches):
            full = np.zeros(1 << BITS, bool)
            for batch in batches:
                numbers = batch.column("number").drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
                for place in _places(numbers):
                    full[place] = True
            words = np.packbits(full, bitorder="little").view(np.int64)
            used = np.flatnonzero(words)
            yield pa.RecordBatch.from_pydict({"word": used, "bits": words[used]})

        rows = df.select(F.col(column).cast("long").alias("number")).mapInArrow(run, "word long, bits long")
        found = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        return cls(found.column("word").to_numpy(), found.column("bits").to_numpy())

    def opened(self) -> np.ndarray:
        """The whole filter, for `has`; once a task."""
        full = np.zeros((1 << BITS) // 64, np.int64)
        full[self.words] = self.bits
        return full.view(np.uint8)


def has(opened: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    a, b = _places(numbers)
    return (opened[a >> 3] >> (a & 7).astype(np.uint8)) & (opened[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
