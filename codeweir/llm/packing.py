"""Packing along a space-filling curve.

Each document is a vector of signed word-hash counts, projected to a few dimensions;
its cell's place on the Hilbert curve, then a hash of its id, orders all documents.
The order is cut into ranges of about equal bytes at quantiles, and each range is
packed by itself, one document's ids after the other, so neighbours on the curve share
sequences and only a range's last sequence has padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.llm.common import bounded_batches, mix, row_slices, table, text_buffers, word_hashes
from codeweir.llm.tokens import default_vocabulary, encoder

SEQUENCE = 1024
DIMS, BITS = 6, 5
#: Where half of an axis's cells lie on either side of the middle.
SPREAD = 4.0
#: Bytes of text in a range, and the most ranges (a longer order has larger ranges,
#: which are packed as a stream).
RANGE_BYTES, MAX_RANGES = 4 << 20, 4096
#: Bytes of text that count as one more key when quantiles are taken.
KEY_BYTES = 1024


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of non-negative cell coordinates below
    2**bits: Gray-code reflections are undone a bit at a time, then bits interleave."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projected(words: np.ndarray, woffs: np.ndarray) -> np.ndarray:
    """Each value's vector of word counts under DIMS random signs, by its length: rows of
    DIMS numbers of about unit size."""
    n = len(woffs) - 1
    out = np.zeros((n, DIMS))
    counts = np.diff(woffs)
    h = mix(words)
    for d in range(DIMS):
        signs = ((h >> np.uint64(7 * d + 3)) & np.uint64(1)).astype(np.int64) * 2 - 1
        sums = np.concatenate(([0], np.cumsum(signs)))
        out[:, d] = (sums[woffs[1:]] - sums[woffs[:-1]]) / np.sqrt(np.maximum(counts, 1))
    return out


def curve_keys(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    keys = []
    for i, j in row_slices(offs, 1 << 20):
        part = offs[i : j + 1]
        v = projected(*word_hashes(data[part[0] : part[-1]], part - part[0]))
        # Axes are squashed, not clipped, so that long texts of many common words keep apart.
        cells = np.minimum(((0.5 + np.arctan(v / SPREAD) / np.pi) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        keys.append(hilbert_keys(cells, BITS))
    return np.concatenate(keys) if keys else np.zeros(0, np.int64)


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Curve key (the Hilbert place, then 31 bits of a hash of the id) and bytes of text; a long
    text's key once for each KEY_BYTES begun, so that quantiles cut bytes and not rows."""

    def run(batches):
        for b in batches:
            data, offs = text_buffers(b.column("__text"))
            keys, size = (curve_keys(data, offs) << 31) | b.column("__tie").to_numpy().astype(np.int64), np.diff(offs)
            times = 1 + size // KEY_BYTES
            shares = np.repeat(np.minimum(size, KEY_BYTES), times)
            shares[np.cumsum(times) - 1] = size % KEY_BYTES
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, times)), pa.array(shares)], names=["__key", "__size"])

    return docs.select(F.col(text_col).alias("__text"), _tie(id_col).alias("__tie")).mapInArrow(run, "__key long, __size long")


def _tie(id_col: str):
    return F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 31) - 1))


def _places(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of so many partitions a number that a repartition by it puts there, so that each
    range has a task of its own."""
    at = F.pmod(F.hash("id"), F.lit(parts))
    tries = 20 * parts + 200
    found = {r["at"]: r["id"] for r in spark.range(tries).groupBy(at.alias("at")).agg(F.min("id").alias("id")).collect()}
    return np.array([found.get(p, tries + p) for p in range(parts)], np.int64)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and
    ids (unsigned 16-bit, little-endian).

    Null and empty texts are the closing id 0 alone. Rows that repeat an id are packed
    each. An empty table gives an empty result; other columns are ignored.
    """
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    bounded_batches(spark)
    points = [i / MAX_RANGES for i in range(1, MAX_RANGES)]
    size, found = with_keys(docs, id_col, text_col).agg(F.sum("__size"), F.percentile_approx("__key", points, 10 * MAX_RANGES)).first()
    ranges = int(min(MAX_RANGES, max(1, -(-(size or 0) // RANGE_BYTES))))
    cuts = sorted({found[i * MAX_RANGES // ranges - 1] for i in range(1, ranges)})
    bounds = spark.sparkContext.broadcast(np.array(cuts, np.int64))  # at most MAX_RANGES numbers
    places = spark.sparkContext.broadcast(_places(spark, len(cuts) + 1))

    def encoded(batches):
        enc = encoder(path)
        for b in batches:
            text, ids = b.column("__text"), b.column("__id")
            data, offs = text_buffers(text)
            tie = b.column("__tie").to_numpy().astype(np.int64)
            for i, j in row_slices(offs, 4 << 20):
                part = offs[i : j + 1]
                keys = (curve_keys(data[part[0] : part[-1]], part - part[0]) << 31) | tie[i:j]
                made = [enc.encode(t or "") for t in text.slice(i, j - i).to_pylist()]
                ranges = np.searchsorted(bounds.value, keys, "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(keys), pa.array(ranges), pa.array(places.value[ranges]), pa.array(made, pa.binary())],
                    names=["__id", "__key", "__range", "__place", "__ids"],
                )

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), _tie(id_col).alias("__tie"))
    kind = rows.schema["__id"].dataType.simpleString()
    tokens = rows.mapInArrow(encoded, f"__id {kind}, __key long, __range int, __place long, __ids binary")
    tokens = tokens.repartition(len(cuts) + 1, "__place").sortWithinPartitions("__range", "__key", "__id")

    def packed(batches):
        at, fill, seq = -1, 0, 0
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            pieces = 0
            for doc, rng, raw in zip(b.column("__id").to_pylist(), b.column("__range").to_pylist(), b.column("__ids").to_pylist()):
                if rng != at:
                    at, fill, seq = rng, 0, 0
                ids = np.append(np.frombuffer(raw, np.uint16), np.uint16(0))
                wide, start, n = ids.astype("<u4").tobytes(), 0, len(ids)
                while start < n:
                    take = min(n - start, SEQUENCE - fill)
                    for c, x in zip(cols, (doc, start, take, zlib.crc32(wide[4 * start : 4 * (start + take)]), n, (rng << 32) | seq, fill, ids[start : start + take].tobytes())):
                        c.append(x)
                    start, fill, pieces = start + take, fill + take, pieces + 1
                    if fill == SEQUENCE:
                        fill, seq = 0, seq + 1
                if pieces >= 4096:
                    yield _batch(cols, b.schema.field("__id").type, id_col)
                    cols, pieces = [[] for _ in range(8)], 0
            if pieces:
                yield _batch(cols, b.schema.field("__id").type, id_col)

    return tokens.mapInArrow(packed, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def _batch(cols: list[list], id_type, id_col: str) -> pa.RecordBatch:
    kinds = [id_type, *[pa.int64()] * 6, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")
