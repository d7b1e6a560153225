"""Shared helpers: the shared folder, checked broadcasts, and vectorised text
hashing over Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every operator here splits words.
SPACE = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is
    unset and all runs on this machine (tests), a temporary folder of our own; on a
    cluster, where executors wouldn't see such a folder, an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="codeweir-")
        sc.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back. Cuts lineage, and survives the
    loss of any executor. The write's shuffle files go when it ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch: what a Python worker holds of a scan at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, which are 10,000 rows of any size by default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def removed(spark: SparkSession, frames: list[DataFrame]) -> None:
    """Delete the folders of written tables that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of rows (their values, not Spark's overhead) that a broadcast may have.
BROADCAST_BYTES = 16 << 20


def checked_broadcast(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast only if it has at most max_rows rows of max_bytes
    in all; otherwise it is returned as it is and the join shuffles."""
    wide = [c for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith(("array", "map", "struct"))]
    size = sum((F.coalesce(F.octet_length(F.to_json(F.struct(*wide))), F.lit(0)) if wide else F.lit(0), F.lit(8 * (len(df.columns) - len(wide)))), F.lit(0))
    n, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if n <= max_rows and (total or 0) <= max_bytes else df


def merged_by_tree(parts: DataFrame, tasks: int, merge, schema: str, fan: int = 256) -> DataFrame:
    """Partial results (slot, node, ...) of so many tasks, united by slot: at most fan meet in a
    group, so that no group grows with the input. merge takes a table of one slot and gives
    one row (slot, node, ...), in which node is the group's."""
    while tasks > fan:
        parts = parts.withColumn("node", F.floor(F.col("node") / fan).cast("int"))
        parts = parts.groupBy("slot", "node").applyInArrow(merge, schema)
        tasks = -(-tasks // fan)
    return parts.groupBy("slot").applyInArrow(merge, schema)


def total_bytes(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows and bytes of text."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()
    return n, size or 0


# --- Arrow text as numpy ---------------------------------------------------


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and the n + 1 offsets of its values."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


#: Bytes hashed at a time: what bounds the memory of word_hashes().
BLOCK = 1 << 19
#: Bytes of a word that one sum covers; longer words have several, each mixed by itself.
PIECE = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE_STEP, _LENGTH_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA24BAED4963EE407)
#: The first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _hashed(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the words of data, eight bytes after another mixed in: nothing is a power of a
    base, so no repeating letters cancel out."""
    if not len(start):
        return np.zeros(0, np.uint64)
    several = length.max() > PIECE
    if several:
        pieces = -(-length // PIECE)
        head = np.cumsum(pieces) - pieces
        nth = np.arange(int(pieces.sum())) - np.repeat(head, pieces)
        whole, start = length, np.repeat(start, pieces) + nth * PIECE
        length = np.minimum(np.repeat(length, pieces) - nth * PIECE, PIECE)
    raw = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))
    h, live, at = length.astype(np.uint64) * _LENGTH_STEP, slice(None), 0
    while True:
        left = length[live] - at
        h[live] = mix(h[live] ^ (eight[start[live] + at] & _FIRST[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        live, at = more if at == 0 else live[more], at + 8
    if not several:
        return h
    later = nth > 0
    h[later] = mix(h[later] + nth[later].astype(np.uint64) * _PIECE_STEP)
    out, long = np.add.reduceat(h, head), pieces > 1
    out[long] = mix(out[long] + whole[long].astype(np.uint64) * _LENGTH_STEP)
    return out


def word_spans(data: np.ndarray, offs: np.ndarray, lower: bool = True, inside: np.ndarray = _IN_WORD):
    """Yield (hashes, starts, ends) of the words, in order, a block of text at a
    time. inside: which of the 256 bytes a word has (default: all but ASCII white space).
    Blocks end between words or between values, so no word is cut. Different words
    have the same 64-bit hash with a probability of 2**-64, whatever their letters."""
    n, pos = len(data), 0
    while pos < n:
        end = min(n, pos + BLOCK)
        if end < n:
            stop = int(offs[np.searchsorted(offs, end)])
            while end < stop:
                gap = np.flatnonzero(~inside[data[end : min(stop, end + 4096)]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(stop, end + 4096)
        full = inside[data[pos:end]]
        first, last = full.copy(), full.copy()
        first[1:] &= ~full[:-1]
        last[:-1] &= ~full[1:]
        cuts = offs[np.searchsorted(offs, pos) : np.searchsorted(offs, end)] - pos
        first[cuts] = full[cuts]
        cuts = cuts[cuts > 0]
        last[cuts - 1] = full[cuts - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        part = _LOWER[data[pos:end]] if lower else data[pos:end]
        yield _hashed(part, s, e - s), s + pos, e + pos
        pos = end


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the n + 1 word offsets of the values."""
    hs, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for h, s, _ in word_spans(data, offs, lower):
        hs.append(h)
        starts.append(s)
    at = np.concatenate(starts)
    return np.concatenate(hs), np.searchsorted(at, offs)


_GRAM = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xAAF7F3B1C5B5A2D9, 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F, 0xE7037ED1A0B428DB, 0xD1B54A32D192ED03, 0x2545F4914F6CDD1D)]
#: Words in a shingle, at most.
MAX_WORDS = len(_GRAM)


def shingle_sets(words: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each value as sorted 64-bit hashes, and their
    n + 1 offsets. A value of fewer words has its whole sequence as one shingle; one
    without words has none."""
    m, n = len(words), len(woffs) - 1
    counts = np.diff(woffs)
    grams = np.zeros(max(0, m - k + 1), np.uint64)
    for j in range(k):
        grams += words[j : m - k + 1 + j] * _GRAM[j]
    grams = mix(grams)
    out, sizes = [np.zeros(0, np.uint64)], np.zeros(n, np.int64)
    for i in range(n):
        c = counts[i]
        if c >= k:
            x = np.sort(grams[woffs[i] : woffs[i + 1] - k + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif c:
            part = words[woffs[i] : woffs[i + 1]]
            x = mix((part * np.array(_GRAM[: len(part)])).sum(keepdims=True, dtype=np.uint64) + np.uint64(int(c) * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF))
        else:
            continue
        out.append(x)
        sizes[i] = len(x)
    return np.concatenate(out), np.concatenate(([0], np.cumsum(sizes)))


def row_slices(offs: np.ndarray, limit: int):
    """Ranges of rows with about limit bytes of text each (a longer row: alone)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
