"""Stupid-backoff scores over count tables partitioned by hash.

Documents are dealt into chunks; each chunk explodes its n-grams and sends its distinct
ones, with their counts, to the hash partitions of the count table. A partition adds
up the counts of all chunks and joins them back to each chunk's n-grams, where they
are summed for each document. What is sent is packed: sorted 64-bit hashes, delta by
byte planes, so no n-gram is a row of its own. Nothing is pruned before counting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.llm.common import mix, table, text_buffers, total_bytes, word_hashes

#: Bytes of text in a chunk, and of packed n-grams in a partition of the count table.
CHUNK_BYTES, PART_BYTES = 8 << 20, 8 << 20
#: n-grams seen fewer times back off; the factor of doing so; words in the longest n-gram.
LEAST, ALPHA, ORDER = 2, 0.4, 2
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)


def packed(hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes as differences, by byte planes (the high ones compress)."""
    d = np.diff(hashes, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    c = counts.astype("<u4" if not len(counts) or counts.max() < 1 << 32 else "<u8")
    return bytes([c.itemsize]) + np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes()


def unpacked_counts(raw: bytes) -> np.ndarray:
    k = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(k, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{k}").ravel().astype(np.int64)


def grams(text_column, order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of a chunk's words, of the bigrams that end at each, and so on up to the order
    (0 where a document has too few words before one), and the documents' word offsets."""
    words, offs = word_hashes(*text_buffers(text_column))
    place = np.arange(len(words)) - np.repeat(offs[:-1], np.diff(offs))
    found = [words]
    for k in range(1, order):
        longer = np.zeros(len(words), np.uint64)
        if len(words):
            longer[1:] = mix(found[-1][:-1] * _NEXT + mix(words[1:]))
            longer[place < k] = 0
        found.append(longer)
    return found, offs


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    if not len(h):
        return h, np.zeros(0, np.int64)
    cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[cut], np.diff(np.append(cut, len(h)))


def _parts(h: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the parts of the hash range begins in sorted hashes, and the end."""
    step = (1 << 64) // parts + 1
    bounds = np.array([min(i * step, (1 << 64) - 1) for i in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(h, bounds), [len(h)]))


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, alpha: float = ALPHA, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row a document: id, n_words, n_backoff (words scored by their own count), log_score
    (natural; sum over words) and mean_log_score (null without words).

    A word scores count(n-gram) / count(n-gram without the word) by the n-gram of `order` words
    that ends at it if that is seen at least `least` times in the whole table, else alpha
    times its score by one word less, down to count(word) / all words. Where a document has
    fewer words before it, those are all, at no cost. Words are what ASCII white space leaves, with
    A-Z lowered. Null and empty texts have 0 words and a score of 0; repeated rows count
    and are scored each. An empty table gives an empty result.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    _, size = total_bytes(docs, text_col)
    chunks = max(1, -(-size // chunk_bytes))
    parts = max(1, -(-2 * size // part_bytes))
    chunk = F.pmod(F.xxhash64(F.col(id_col), F.length(text_col)), F.lit(chunks)).alias("__chunk")
    rows = docs.select(chunk, F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))

    def emit(t: pa.Table) -> pa.Table:
        found, _ = grams(t["__text"], order)
        out: dict[str, list] = {"part": [], "order": [], "chunk": [], "hashes": [], "counts": []}
        for n, h in enumerate(found, 1):
            h, c = _distinct(h if n == 1 else h[h != 0])
            at = _parts(h, parts)
            for p in np.flatnonzero(np.diff(at)):
                s = slice(at[p], at[p + 1])
                for k, x in zip(out, (int(p), n, t["__chunk"][0].as_py(), packed(h[s]), packed_counts(c[s]))):
                    out[k].append(x)
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))})

    def count(t: pa.Table) -> pa.Table:
        hashes = [unpacked(x) for x in t["hashes"].to_pylist()]
        counts = [unpacked_counts(x) for x in t["counts"].to_pylist()]
        every = np.concatenate(hashes)
        by = np.argsort(every, kind="stable")
        every = every[by]
        cut = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        sums = np.add.reduceat(np.concatenate(counts)[by], cut)
        every = every[cut]
        back = [packed_counts(sums[np.searchsorted(every, h)]) for h in hashes]
        return pa.table({"chunk": t["chunk"], "order": t["order"], "part": t["part"], "counts": pa.array(back, pa.binary())})

    def score(t: pa.Table, known: pa.Table) -> pa.Table:
        found, offs = grams(t["__text"], order)
        words = found[0]
        rows_in = sorted(zip(known["order"].to_pylist(), known["part"].to_pylist(), known["counts"].to_pylist()), key=lambda r: r[:2])
        backed = np.zeros(len(words), bool)
        for k, h in enumerate(found, 1):
            total = np.concatenate([np.zeros(0, np.int64), *(unpacked_counts(c) for o, _, c in rows_in if o == k)])
            has = h != 0 if k > 1 else np.ones(len(h), bool)
            seen = np.zeros(len(h), np.int64)
            seen[has] = total[np.searchsorted(_distinct(h[has])[0], h[has])]
            if k == 1:
                logs = np.log(np.maximum(seen, 1)) - log_n
            else:
                before = np.concatenate(([1], shorter[:-1]))[: len(h)]
                logs = np.where(has & (seen >= least), np.log(np.maximum(seen, 1)) - np.log(np.maximum(before, 1)), logs + np.where(has, np.log(alpha), 0.0))
            if k == 2:
                backed = has & (seen < least)
            shorter = seen
        backs = np.concatenate(([0], np.cumsum(backed)))
        n = np.diff(offs)
        log_score = np.array([logs[a:b].sum() for a, b in zip(offs[:-1], offs[1:])])
        mean = pa.array(log_score / np.maximum(n, 1), mask=n == 0)
        return pa.table({id_col: t["__id"], "n_words": pa.array(n), "n_backoff": pa.array(backs[offs[1:]] - backs[offs[:-1]]), "log_score": pa.array(log_score.astype(np.float64)), "mean_log_score": mean})

    # The number of all words, the only figure of the corpus that every task needs.
    n_words = docs.select(F.sum(F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))).first()[0] or 0
    log_n = float(np.log(max(n_words, 1)))
    sent = rows.groupBy("__chunk").applyInArrow(emit, "part int, order int, chunk long, hashes binary, counts binary")
    back = sent.groupBy("order", "part").applyInArrow(count, "chunk long, order int, part int, counts binary")
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.groupBy("__chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, f"`{id_col}` {kind}, n_words long, n_backoff long, log_score double, mean_log_score double")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff_scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
p AS (SELECT r, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v, i FROM w),
one AS (SELECT w, count(*) AS c FROM w GROUP BY w),
two AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w),
n AS (SELECT count(*) AS n FROM w),
s AS (
  SELECT r, count(*) AS n_words, sum(CASE WHEN p.v IS NOT NULL AND two.c < 2 THEN 1 ELSE 0 END) AS n_backoff,
         sum(CASE WHEN two.c >= 2 THEN ln(two.c) - ln(prev.c) ELSE ln(one.c) - ln((SELECT n FROM n)) + CASE WHEN p.v IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END END) AS log_score
  FROM p JOIN one ON one.w = p.w LEFT JOIN two ON two.v = p.v AND two.w = p.w LEFT JOIN one AS prev ON prev.w = p.v
  GROUP BY r)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_backoff, 0) AS BIGINT) AS n_backoff,
       round(coalesce(log_score, 0), 4) AS log_score, round(log_score / n_words, 6) AS mean_log_score
FROM d LEFT JOIN s ON s.r = d.r
"""
