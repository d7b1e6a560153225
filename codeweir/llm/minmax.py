"""Near duplicates by min-max hashing, confirmed on whole sets.

Each permutation (a salted 64-bit mix) of a set's shingles gives two values, its minimum and
its maximum: twice the signature of a hash evaluation, and an unbiased estimate of the
similarity whose variance is below that of as many separate minima. A band is all four
values of two neighbouring permutations, in a circle, so every permutation is in two bands.
Sets meet where a band agrees; the number of permutations is what keeps the probability that a
linked pair shares none below a given one (1e-9).

1. In each band's bucket the members of other components are tried against one hub, first
   in a few bands, then in all as long as that joins many. This costs a large family its spanning links, not its pairs.
2. Where a bucket still holds several components, its members meet in blocks of bounded size:
   pairs are compared by signature, each in the first band that it shares, and those
   that may link are confirmed there, if their components are still apart. A block gives
   the links that join components, not its pairs.

Only pairs confirmed on the sets of whole texts are links.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.llm.bloom import Bloom
from codeweir.llm.common import MAX_WORDS, bounded_batches, checked_broadcast, mix, removed, table, written
from codeweir.llm.components import star_round
from codeweir.llm.ngram_join import MAX_BROADCAST, completed, linked, sets_of, verified

#: Shingles of a chunk's members, on average; a block joins two chunks of a bucket.
CHUNK = 300_000
#: Shingles that are put into one group of blocks, on average.
GROUP = 500_000
#: Pairs whose signatures are compared at a time.
COMPARED = 1 << 16
#: Bands that the first rounds ask for hubs; later ones ask all.
FIRST_BANDS = (4,)
#: Rounds of hubs at most; what they don't join is left to the second step.
ROUNDS = 10
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def agreement(percent: int) -> float:
    """The least probability with which a permutation's minimum and maximum both agree, over linked
    sets of any size: both ends of the union lie in the intersection."""
    least = (percent / 100) ** 2
    for union in range(3, 200):
        common = -(-percent * union // 100)
        if common < union:
            least = min(least, common * (common - 1) / (union * (union - 1)))
    return least


def permutations(percent: int, miss: float = 1e-9) -> int:
    """So many permutations that a linked pair shares no band with a probability below miss: no two
    neighbours in a circle agree."""
    p = agreement(percent)
    root = np.sqrt((1 - p) ** 2 + 4 * p * (1 - p))
    a, b = (1 - p + root) / 2, (1 - p - root) / 2
    return next(n for n in range(3, 10_000) if a**n + b**n < miss)


def least_agreeing(percent: int, values: int, miss: float = 1e-12) -> int:
    """Values of a signature in which linked sets agree at least, but for a probability below miss."""
    p, tail = percent / 100, 0.0
    for n in range(values + 1):
        tail += comb(values, n) * p**n * (1 - p) ** (values - n)
        if tail > miss:
            return n
    return values


def min_max(sets: np.ndarray, offs: np.ndarray, hashes: int) -> np.ndarray:
    """Minimum and maximum of each non-empty set under each permutation: an array of sets by
    permutations by two."""
    starts = offs[:-1][np.diff(offs) > 0]
    out = np.zeros((len(starts), hashes, 2), np.uint64)
    if len(starts):
        for p, salt in enumerate(mix(np.arange(1, hashes + 1, dtype=np.uint64) * _A)):
            h = mix(sets ^ salt)
            out[:, p, 0] = np.minimum.reduceat(h, starts)
            out[:, p, 1] = np.maximum.reduceat(h, starts)
    return out


def band_keys(ends: np.ndarray) -> np.ndarray:
    """A key for each two neighbouring permutations, as signed numbers."""
    each = mix(mix(ends[:, :, 0]) + ends[:, :, 1] * _B)
    nth = np.arange(each.shape[1], dtype=np.uint64) * _A
    return mix(mix(each + nth) + np.roll(each, -1, axis=1) * _B).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, hashes: int) -> DataFrame:
    """id, n (size of the set), digest (of the set), bands, and sig: a byte of each minimum and
    maximum."""

    def run(batches):
        for b in batches:
            n, digests, sigs, keys = [], [], [], [np.zeros((0, hashes), np.int64)]
            for _, sets, offs in sets_of(b.column("text"), k):
                ends = min_max(sets, offs, hashes)
                keys.append(band_keys(ends))
                short = iter((ends & np.uint64(255)).astype(np.uint8).reshape(len(ends), -1))
                for a, z in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    n.append(z - a)
                    digests.append(hashlib.blake2b(sets[a:z].tobytes(), digest_size=16).digest())
                    sigs.append(next(short).tobytes() if z > a else b"")
            flat, sizes = np.concatenate(keys).ravel(), np.where(np.array(n, np.int64) > 0, hashes, 0)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), bands, pa.array(sigs, pa.binary())], names=["id", "n", "digest", "bands", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, digest binary, bands array<long>, sig binary")


def _matrix(col, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, width)


def labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries with comp: a node that the links so far connect with the entry's class."""
    if labels is None:
        return entries.withColumn("comp", F.col("cid"))
    return entries.join(checked_broadcast(labels, MAX_BROADCAST), F.col("cid") == F.col("node"), "left").withColumn("comp", F.coalesce("label", "cid")).drop("node", "label")


def unsettled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries (nth, band, cid, n) with their component, and m (shingles of the bucket's members),
    where a bucket holds several components."""
    rows = labelled(entries, labels)
    counted = rows.groupBy(F.col("band").alias("g_band")).agg(F.sum("n").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("g_band", "m")
    counted = written(counted, "minmax-buckets")
    out = written(rows.join(checked_broadcast(counted, MAX_BROADCAST), F.col("band") == F.col("g_band")).drop("g_band"), "minmax-unsettled")
    removed(entries.sparkSession, [counted])
    return out


def hub_pairs(rows: DataFrame, nth: int, percent: int) -> DataFrame:
    """a, b, lo, hi: members of components (b) with hubs (a) of other components, of sizes that may
    link. Each bucket has a hub, another one for every nth; of the hubs of a member's buckets two
    are tried, that of most buckets and one by chance."""
    order = F.xxhash64("cid", F.lit(nth))
    hubs = rows.groupBy(F.col("band").alias("h_band")).agg(F.min_by(F.struct("cid", "comp", "n"), order).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    hubs = written(hubs.select("h_band", F.col("hub.cid").alias("h_cid"), F.col("hub.comp").alias("h_comp"), F.col("hub.n").alias("h_n")), "minmax-hubs")
    met = rows.join(checked_broadcast(hubs, MAX_BROADCAST), F.col("band") == F.col("h_band"))
    reps = met.groupBy("band", "comp", "h_cid", "h_comp", "h_n").agg(F.min_by(F.struct("cid", "n"), order).alias("rep"))
    reps = reps.where("comp <> h_comp").where(100 * F.least("rep.n", "h_n") >= percent * F.greatest("rep.n", "h_n"))
    # All of a member's hubs meet in one task, so both groupings need one shuffle.
    tries = reps.select(F.col("rep.cid").alias("cid"), "comp", F.struct(F.col("h_cid").alias("cid"), F.col("h_comp").alias("comp")).alias("hub")).repartition("cid", "comp")
    tries = tries.groupBy("cid", "comp", "hub").agg(F.count(F.lit(1)).alias("times"))
    chance = F.xxhash64("hub.cid", F.lit(nth))
    tried = F.array_distinct(F.array(F.max_by("hub", F.struct("times", chance)), F.max_by("hub", chance)))
    tries = tries.groupBy("cid", "comp").agg(tried.alias("hubs")).select("cid", "comp", F.explode("hubs").alias("hub"))
    out = written(tries.select(F.col("hub.cid").alias("a"), F.col("cid").alias("b"), F.col("hub.comp").alias("lo"), F.col("comp").alias("hi")), "minmax-pairs")
    removed(rows.sparkSession, [hubs])
    return out


def meeting(bands: np.ndarray, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, sigs: np.ndarray, all_bands: np.ndarray, sides: np.ndarray, percent: int) -> np.ndarray:
    """Places (i, j) of members of one bucket and different components whose sizes and signatures
    may belong to linked sets, in the first of the bands that they share. sides: 0 and 1 for
    members of the two chunks of a block, which meet each other only; 2: the chunk
    meets itself."""
    least = least_agreeing(percent, sigs.shape[1])
    by = np.lexsort((ids, sides, bands))
    bands, found = bands[by], [np.zeros((2, 0), np.int64)]
    cut = np.flatnonzero(np.concatenate(([True], bands[1:] != bands[:-1])))
    end = np.repeat(np.append(cut[1:], len(bands)), np.diff(np.append(cut, len(bands))))
    at = np.arange(len(bands))
    for step in range(1, int((end - at).max(initial=1))):
        at = at[at + step < end[at]]
        for s in range(0, len(at), COMPARED):
            i, j = by[at[s : s + COMPARED]], by[at[s : s + COMPARED] + step]
            good = (comp[i] != comp[j]) & (ids[i] != ids[j]) & ((sides[i] != sides[j]) | (sides[i] == 2))
            good &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[good], j[good]
            good = (sigs[i] == sigs[j]).sum(1) >= least
            i, j = i[good], j[good]
            shared = all_bands[i] == all_bands[j]
            first = all_bands[i, shared.argmax(1)]
            own = first == bands_of(bands, by, i)
            found.append(np.stack((i[own], j[own])))
    return np.concatenate(found, axis=1)


def bands_of(sorted_bands: np.ndarray, by: np.ndarray, i: np.ndarray) -> np.ndarray:
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    return sorted_bands[back[i]]


def bucket_links(docs: DataFrame, entries: DataFrame, classes: DataFrame, id_col: str, text_col: str, k: int, percent: int, hashes: int) -> DataFrame:
    """a, b: components that confirmed links join, of members of unsettled buckets. Every two members
    of different components that may link are confirmed on their sets, in the first bucket
    that they share, unless links of the same block have joined their components by then."""
    groups = max(1, -(-(entries.agg(F.sum("n")).first()[0] or 0) // GROUP))
    rows = entries.withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(F.col("own") == o, 2).when(F.col("own") < o, 0).otherwise(1).alias("side")))
    # A bucket of one chunk shares its group with others; a block of a larger one is a group.
    rows = rows.select("band", "cid", "comp", "chunks", F.explode(pair).alias("p"))
    grp = F.when(F.col("chunks") == 1, F.pmod("band", F.lit(groups))).otherwise(-1 - F.pmod(F.xxhash64("band", "p.i", "p.j"), F.lit(1 << 40)))
    # What a member needs besides its text is brought once a class; the text goes with each of its buckets.
    need = rows.select("cid", "comp", F.struct(grp.alias("grp"), "band", F.col("p.side").alias("side")).alias("at")).groupBy("cid", "comp").agg(F.collect_list("at").alias("places"))
    need = written(need.join(classes.select(F.col("cid").alias("k_cid"), "digest", "n", "sig", "bands"), F.col("cid") == F.col("k_cid")).drop("k_cid"), "minmax-need")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bloom = Bloom(need, "cid")
    met = bloom.filtered(texts, F.col("id")).join(checked_broadcast(need, MAX_BROADCAST), F.col("id") == F.col("cid"))
    met = met.select("cid", "comp", "digest", "n", "sig", "bands", "text", F.explode("places").alias("at")).select("at.*", "cid", "comp", "digest", "n", "sig", "bands", "text")

    def run(t: pa.Table) -> pa.Table:
        flat = pa.concat_arrays(t["bands"].chunks).flatten().to_numpy()
        ids, comp = t["cid"].to_numpy(), t["comp"].to_numpy()
        sets, digests = {}, t["digest"].to_pylist()
        for _, s, offs in sets_of(t["text"], k):
            for x, z in zip(offs[:-1], offs[1:]):
                sets[hashlib.blake2b(s[x:z].tobytes(), digest_size=16).digest()] = s[x:z]
        i, j = meeting(t["band"].to_numpy(), ids, comp, t["n"].to_numpy(), _matrix(t["sig"], 2 * hashes), flat.reshape(-1, hashes), t["side"].to_numpy(), percent)
        root, out = {}, []

        def find(x):
            while x in root:
                x = root[x]
            return x

        for x, y in zip(i.tolist(), j.tolist()):
            p, q = find(int(comp[x])), find(int(comp[y]))
            # A row of an id with several texts may be beside a set that isn't its own.
            if p != q and digests[x] in sets and digests[y] in sets and linked(sets[digests[x]], sets[digests[y]], percent):
                root[max(p, q)] = min(p, q)
                out.append((min(p, q), max(p, q)))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    out = written(met.groupBy("grp").applyInArrow(run, "a long, b long"), "minmax-links")
    bloom.close()
    removed(docs.sparkSession, [need])
    return out


def nearer(edges: DataFrame | None, links: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Edges (u above v) that connect what edges and links (a, b) connect, after one round of stars,
    and each node's label, the smallest node that it has an edge to. A round between hubs needn't bring
    components to their end: no link is lost, as all edges are kept. Deletes the tables that it is given."""
    more = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    out = star_round(more if edges is None else edges.union(more))
    removed(links.sparkSession, [x for x in (edges, links, labels) if x is not None])
    return out, written(out.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")), "minmax-labels")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, miss: float = 1e-9) -> DataFrame:
    """One row for each input row: id, n_shingles, component_id (the smallest id that links
    reach, itself included) and kept (whether that is its own).

    Texts are split at ASCII white space, with A-Z lowered; a text of fewer words than a
    shingle has its whole sequence as one. Two documents link when 100 * intersection >=
    percent * union of their sets (percent: 70 to 100). A link is missed with a probability
    below miss. Null and empty texts have no shingles and no links. A row with a null id
    has no links and a null component, and is kept. Rows that repeat an id are one
    document: it has the links of each. Whole texts are read, however long. An empty table
    gives an empty result; other columns are ignored.
    """
    if not 70 <= percent <= 100:
        raise ValueError("percent must lie between 70 and 100")
    if not 1 <= words <= MAX_WORDS:
        raise ValueError(f"words must lie between 1 and {MAX_WORDS}")
    spark = docs.sparkSession
    bounded_batches(spark)
    hashes = permutations(percent, miss)
    known = written(signatures(docs, id_col, text_col, words, hashes), "minmax-keys")
    some = known.where("id is not null and n > 0")
    classes = written(some.groupBy("digest").agg(F.min("id").alias("cid"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig")), "minmax-classes")
    entries = classes.select("cid", "n", F.posexplode("bands").alias("nth", "band"))
    entries = unsettled(entries, None).select("nth", "band", "cid", "n")
    edges = labels = None
    for nth in range(ROUNDS):
        # A few bands first: they join most of a large family, before all ask for its hubs.
        few = FIRST_BANDS[nth] if nth < len(FIRST_BANDS) else hashes
        rows = written(labelled(entries.where(F.col("nth") < few), labels), "minmax-unsettled")
        pairs = hub_pairs(rows, nth, percent)
        links = verified(docs, pairs, id_col, text_col, words, percent)
        tried, found = pairs.count(), links.count()
        removed(spark, [rows, pairs])
        if found:
            edges, labels = nearer(edges, links, labels)
        if few >= hashes and 16 * found <= tried:
            break
    rows = unsettled(entries, labels)
    links = bucket_links(docs, rows, classes, id_col, text_col, words, percent, hashes)
    removed(spark, [rows, entries])
    # What the rounds left of their links goes with those of the blocks: components are whole only now.
    if edges is not None:
        removed(spark, [labels])
        links = links.union(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    comps = written(classes.select("cid", F.col("cid").alias("comp")).distinct(), "minmax-state")
    out = completed(known, some, classes.select("digest", "cid"), comps, links, id_col)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op12_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), words=3, percent=85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id,
  w.doc_id <= coalesce(min(r.b), w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
"""
