"""Ranked lexical search by sort-based accumulation, in 64-bit integers.

Items are searched in blocks of bounded size, each against all documents. One pass over the
texts keeps, for every run of documents, what they have of the block's terms (postings), and
from these come the counts of documents by term. Then each run's postings become impacts:
arrays of (item, document, impact) are concatenated, their packed keys sorted by radix, and
equal neighbours added up. As a document lies in one run, its sums are whole there, and heaps
keep the best of each task. What the heaps hold is dealt by ranges of (item, task), so that
no item meets in one place at once, and heaps select again.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeweir.llm.common import bounded_batches, merged_by_tree, removed, row_slices, table, text_buffers, word_spans, written

#: Terms of items (with repeats between items) in a block, on average: 8 MB with their items.
BLOCK_TERMS = 1 << 19
#: (item, document, impact) entries that are sorted at a time, at least one document's.
ENTRIES = 1 << 20
#: Matches that are held before equal ones are counted together.
HELD = 1 << 20
#: Bytes of a term: ASCII letters and digits, and all bytes of characters beyond ASCII.
IN_TERM = np.zeros(256, bool)
IN_TERM[48:58] = IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True

SLICES = 64
_POSTINGS = "docs long, terms long, ids binary, known binary, n binary, counts binary, term binary, tf binary"


def squeezed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True) if len(x) else b""


def loose(raw: bytes, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, size * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if size else np.zeros(0, kind)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, sixteen bits after another from the lowest (a stable sort
    of 16-bit numbers is a radix sort)."""
    order = np.argsort((keys & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for shift in range(16, int(keys.max()).bit_length() if len(keys) else 0, 16):
        order = order[np.argsort((keys[order] >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")]
    return order


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key (of the row), id, n and the row's distinct terms as sorted 64-bit hashes."""

    def run(batches):
        for b in batches:
            data, offs = text_buffers(b.column("text"))
            parts: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            for h, s, _ in word_spans(data, offs, inside=IN_TERM):
                row = np.searchsorted(offs, s, "right") - 1
                for r in np.unique(row):
                    parts[r].append(np.unique(h[row == r]))
            found = [np.unique(np.concatenate(p)) if p else np.zeros(0, np.uint64) for p in parts]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["key", "id", "n", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "key long, id long, n long, terms binary")


class Block:
    """A block of items: its vocabulary, and of each term the items that have it."""

    def __init__(self, rows: list):
        self.keys = np.array([r["key"] for r in rows], np.int64)
        terms = [np.frombuffer(bytes(r["terms"]), np.uint64) for r in rows]
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) for t in terms])
        flat = np.concatenate([np.zeros(0, np.uint64), *terms])
        by = np.argsort(flat, kind="stable")
        self.vocabulary, first = np.unique(flat[by], return_index=True)
        self.items, self.first = owner[by], np.append(first, len(flat)).astype(np.int64)


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """Runs of documents that have terms: their number and that of their terms, and compressed
    arrays of ids (and whether they are known), lengths, matched terms and occurrences. vocabulary: a broadcast."""

    def run(batches):
        words = vocabulary.value
        size = np.uint64(len(words))
        for b in batches:
            ids = b.column("id")
            data, offs = text_buffers(b.column("text"))
            for i, j in row_slices(offs, 4 << 20):
                part, n = offs[i : j + 1], np.zeros(j - i, np.int64)
                keys, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                held = 0
                for h, s, _ in word_spans(data[part[0] : part[-1]], part - part[0], inside=IN_TERM):
                    row = np.searchsorted(part - part[0], s, "right") - 1
                    n += np.bincount(row, minlength=j - i)
                    at = np.searchsorted(words, h)
                    good = np.flatnonzero(words[np.minimum(at, len(words) - 1)] == h) if len(words) else at[:0]
                    found, counted = np.unique(row[good].astype(np.uint64) * size + at[good].astype(np.uint64), return_counts=True)
                    keys.append(found)
                    times.append(counted)
                    held += len(found)
                    if held > HELD:
                        keys, times = ([x] for x in _summed(np.concatenate(keys), np.concatenate(times)))
                        held = len(keys[0])
                key, tf = _summed(np.concatenate(keys), np.concatenate(times))
                row = (key // size).astype(np.int64) if len(key) else np.zeros(0, np.int64)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                own = ids.slice(i, j - i).take(pa.array(some))
                cols = (own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False), n[some], np.bincount(row, minlength=j - i)[some], (key % size if len(key) else key).astype(np.uint32), tf)
                yield pa.RecordBatch.from_arrays([pa.array([len(some)]), pa.array([int(n.sum())]), *(pa.array([squeezed(x)], pa.binary()) for x in cols)], names=["docs", "terms", "ids", "known", "n", "counts", "term", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _POSTINGS)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's values."""
    if not len(keys):
        return keys, values
    by = radix_order(keys)
    keys, values = keys[by], values[by]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values, first)


def _run_arrays(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    raw = {c: b.column(c)[i].as_py() for c in ("docs", "ids", "known", "n", "counts", "term", "tf")}
    m = raw["docs"]
    counts = loose(raw["counts"], m, "<i8")
    total = int(counts.sum())
    return loose(raw["ids"], m, "<i8"), loose(raw["known"], m, "?"), loose(raw["n"], m, "<i8"), counts, loose(raw["term"], total, "<u4"), loose(raw["tf"], total, "<i8")


def documents_with(found: DataFrame, size: int) -> np.ndarray:
    """Of each term of the vocabulary, the documents that have it: tasks count, and a tree adds up."""
    part = -(-max(1, size) // SLICES)
    schema = "slot int, node int, sums binary"

    def count(batches):
        total = np.zeros(part * SLICES, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                total += np.bincount(_run_arrays(b, i)[4], minlength=part * SLICES)
        cells, node = total.reshape(SLICES, part), TaskContext.get().partitionId()
        some = np.flatnonzero(cells.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), node, np.int32)), pa.array([cells[x].tobytes() for x in some], pa.binary())], names=["slot", "node", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(part, np.int64)
        for raw in t["sums"]:
            total += np.frombuffer(raw.as_py(), np.int64)
        return pa.table({"slot": t["slot"][:1], "node": t["node"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((SLICES, part), np.int64)
    for r in merged_by_tree(found.mapInArrow(count, schema), found.rdd.getNumPartitions(), add, schema).collect():  # SLICES rows
        out[r["slot"]] = np.frombuffer(bytes(r["sums"]), np.int64)
    return out.ravel()[:size]


class Best:
    """Heaps of the best (score, smaller id first) of each item."""

    def __init__(self, top: int):
        self.top, self.heaps, self.floor = top, {}, {}

    def offer(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Entries of any items. Of each item's, only the best are looked at one by one."""
        by = np.lexsort((doc, -score, item))
        item, doc, score = item[by], doc[by], score[by]
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.zeros(0, np.int64)
        near = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item)))) < self.top
        for i, d, s in zip(item[near].tolist(), doc[near].tolist(), score[near].tolist()):
            heap = self.heaps.setdefault(i, [])
            if len(heap) < self.top:
                heapq.heappush(heap, (s, -d))
            elif (s, -d) > heap[0]:
                heapq.heapreplace(heap, (s, -d))
            if len(heap) == self.top:
                self.floor[i] = heap[0][0]

    def floors(self, items: int) -> np.ndarray:
        """Scores below which an entry can't be among the best."""
        out = np.ones(items, np.int64)
        out[list(self.floor)] = list(self.floor.values())
        return out

    def batch(self, keys=None) -> pa.RecordBatch:
        """key, doc, score: keys names the items, if they are numbered."""
        rows = [(i if keys is None else int(keys[i]), -d, s) for i, heap in sorted(self.heaps.items()) for s, d in sorted(heap, reverse=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["key", "doc", "score"])


def accumulated(found: DataFrame, lists, weights, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """key, doc, score, node: the best documents of each item in each task. lists and weights:
    broadcasts (bounded by the block)."""

    def run(batches):
        (owners, first, keys), w, best = lists.value, weights.value, Best(top)
        spread = np.diff(first)
        for b in batches:
            for i in range(b.num_rows):
                ids, known, n, counts, term, tf = _run_arrays(b, i)
                m = 100 - 50 + 50 * n * n_docs // n_terms
                doc = np.repeat(np.arange(len(ids)), counts)
                impact = w[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                good = known[doc] & (impact > 0)
                doc, term, impact = doc[good], term[good], impact[good]
                # Documents in order, cut so that a part's entries fit.
                size = np.concatenate(([0], np.cumsum(np.bincount(doc, spread[term], len(ids)).astype(np.int64))))
                edge = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(ids)))))
                for x, z in row_slices(size, ENTRIES):
                    s = slice(edge[x], edge[z])
                    reps = spread[term[s]]
                    if not reps.sum():
                        continue
                    nth = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
                    item = owners[np.repeat(first[term[s]], reps) + nth].astype(np.uint64)
                    key = item * np.uint64(z - x) + np.repeat(doc[s] - x, reps).astype(np.uint64)
                    key, score = _summed(key, np.repeat(impact[s], reps))
                    item, at = (key // np.uint64(z - x)).astype(np.int64), (key % np.uint64(z - x)).astype(np.int64) + x
                    may = score >= best.floors(len(keys))[item]
                    best.offer(item[may], ids[at[may]], score[may])
        yield best.batch(keys)

    rows = found.mapInArrow(run, "key long, doc long, score long")
    return rows.withColumn("node", F.spark_partition_id())


def selected(rows: DataFrame, top: int) -> DataFrame:
    """key, doc, score: of each item's rows in a partition, the best."""

    def run(batches):
        best = Best(top)
        for b in batches:
            best.offer(*(b.column(c).to_numpy() for c in ("key", "doc", "score")))
        yield best.batch()

    return rows.select("key", "doc", "score").mapInArrow(run, "key long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the top documents of each item with a score above 0.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z
    lowered, of whole texts. With N documents that have terms, L their terms, n those of one
    document, df the documents with a term and tf its occurrences, a term weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))) and m is 50 + (50 n N) div L; a document's score
    adds up weight * ((1e9 tf) div (1000 tf + 20 m)) of an item's distinct terms. Equal
    scores are ranked by ascending id. Terms are compared as 64-bit hashes.

    Null and empty texts have no terms: such documents don't count, such items have no
    rows. Documents without an id count, but can't be listed. Each row is a document, and
    each row of items an item, also where ids repeat or are null: rows of documents that
    repeat an id are listed each. Empty tables give an empty result; other columns are
    ignored. What is sent to all tasks is bounded by BLOCK_TERMS, or by the terms
    of one item that has more.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = written(item_terms(items, item_col, item_text).where("n > 0"), "search-items")
    blocks = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // BLOCK_TERMS))
    out, old = [], [asked]
    n_docs = n_terms = None
    for nth in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == nth).collect()  # a block, bounded
        block = Block(rows)
        words = spark.sparkContext.broadcast(block.vocabulary)
        found = written(postings(docs, id_col, text_col, words), "search-postings")
        old.append(found)
        words.destroy()
        if n_docs is None:
            n_docs, n_terms = (int(x or 0) for x in found.agg(F.sum("docs"), F.sum("terms")).first())
        if n_docs and rows:
            df = documents_with(found, len(block.vocabulary))
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
            lists, sent = spark.sparkContext.broadcast((block.items, block.first, block.keys)), spark.sparkContext.broadcast(weights)
            part = written(accumulated(found, lists, sent, n_docs, n_terms, top), "search-heaps")
            lists.destroy()
            sent.destroy()
            # Ranges of (item, task): an item's heaps may lie in several partitions.
            near = selected(part.repartitionByRange("key", "node"), top)
            out.append(written(near, "search-best"))
            old.append(part)
    if not out:
        found = spark.createDataFrame([], "key long, doc long, score long")
    else:
        found = out[0]
        for more in out[1:]:
            found = found.union(more)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), "doc"))).where(F.col("rank") <= top)
    ranked = ranked.join(asked.select(F.col("key").alias("i_key"), "id"), F.col("key") == F.col("i_key"))
    done = written(ranked.select(F.col("id").alias(item_col), "rank", F.col("doc").alias(id_col), "score"), "search-rows")
    removed(spark, [*old, *out])
    return done


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
b AS (
  SELECT row_number() OVER () AS q, item_id,
    list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts
  FROM benchmark),
i AS (SELECT q, item_id, unnest(ts) AS term FROM b),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
p AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM p, c GROUP BY term),
s AS (
  SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM p JOIN w USING (term) JOIN i USING (term) CROSS JOIN c WHERE doc_id IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0)
SELECT item_id, n::INTEGER AS rank, doc_id, score FROM k WHERE n <= 50
"""
