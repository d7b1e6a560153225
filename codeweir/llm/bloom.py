"""A Bloom filter of fixed size over a column of longs, built in parallel: what a large
join doesn't need is left out before it is shuffled. It never leaves out a match; with
more keys than it is made for it only lets more rows through."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweir.llm.common import merged_by_tree, mix

#: 2**25 bits: 4 MB, whatever the input. Slices in which partial filters are united.
BITS, SLICES = 25, 64
_SALT = np.uint64(0x94D049BB133111EB)
_SCHEMA = "slot int, node int, bits binary"


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.astype(np.int64).view(np.uint64) ^ _SALT)
    return (h >> np.uint64(64 - BITS)).astype(np.int64), (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Bloom:
    def __init__(self, keys: DataFrame, column: str):
        """keys: a written table."""
        part = (1 << BITS) // 8 // SLICES

        def build(batches):
            bits = np.zeros(1 << BITS, bool)
            for b in batches:
                for places in _places(b.column(0).to_numpy()):
                    bits[places] = True
            packed = np.packbits(bits).reshape(SLICES, part)
            some = np.flatnonzero(packed.any(1))
            node = np.full(len(some), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(node), pa.array([packed[i].tobytes() for i in some], pa.binary())], names=["slot", "node", "bits"])

        def unite(t: pa.Table) -> pa.Table:
            total = np.zeros(part, np.uint8)
            for raw in t["bits"]:
                total |= np.frombuffer(raw.as_py(), np.uint8)
            return pa.table({"slot": t["slot"][:1], "node": t["node"][:1], "bits": pa.array([total.tobytes()], pa.binary())})

        some = keys.select(F.col(column).cast("long")).where(F.col(column).isNotNull())
        rows = merged_by_tree(some.mapInArrow(build, _SCHEMA), some.rdd.getNumPartitions(), unite, _SCHEMA)
        packed = np.zeros((SLICES, part), np.uint8)
        for r in rows.collect():
            packed[r["slot"]] = np.frombuffer(r["bits"], np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(packed.ravel())

    def has(self, keys: np.ndarray) -> np.ndarray:
        packed = self.sent.value
        a, b = _places(keys)
        return ((packed[a >> 3] >> (7 - (a & 7)) & 1) & (packed[b >> 3] >> (7 - (b & 7)) & 1)).astype(bool)

    def filtered(self, df: DataFrame, key: Column) -> DataFrame:
        """Rows of df whose key (a long) may be among the keys; null keys go."""
        bloom = self

        def run(batches):
            for b in batches:
                raw = b.column(b.num_columns - 1)
                keep = bloom.has(raw.fill_null(0).to_numpy()) & ~raw.is_null().to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(keep)).select(range(b.num_columns - 1))

        return df.select("*", key.cast("long").alias("__bloom")).mapInArrow(run, df.schema)

    def close(self) -> None:
        """Free it everywhere, once all that it filters has been written."""
        self.sent.destroy()
