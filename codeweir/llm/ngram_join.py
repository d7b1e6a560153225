"""N-gram Jaccard join with signature trees, exact and in bounded blocks.

Sets of k-word shingles are collapsed into classes of equal sets, which become components
step by step:

1. Classes that share two minimum hashes meet in blocks of bounded size. A tree over each
   block's bitmaps is traversed against itself, candidates are verified on the sets, and
   pairs that verified links have joined already are left out, so that a group of near
   copies costs its spanning links and not its pairs.
2. A few members of each component meet again by other pairs of hashes, until groups of
   several blocks are joined. These two steps need not find every link; they leave few.
3. Any linked pair shares shingles among the rarest of each set (prefix filter). Only
   shingles that still join different components are kept, and trees over the members of
   each give pairs. First a few members of each component meet, and a few pairs of any two
   components are verified. Then all members meet where components are still apart; the
   pairs that share as many rare shingles as a link must are verified, every one.

The order of rarity comes from a counting sketch of fixed size; it decides the work, not
the result. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.llm.bloom import Bloom
from codeweir.llm.common import MAX_WORDS, bounded_batches, checked_broadcast, merged_by_tree, mix, removed, row_slices, shingle_sets, table, text_buffers, word_hashes, written
from codeweir.llm.components import components
from codeweir.llm.signature_tree import SignatureTree, bitmap, width

SKETCH_BITS, SKETCH_SLICES = 22, 64
ANCHORS = 4
#: Members of a block of the first steps, on average.
BLOCK = 128
#: Members of a third-step chunk (a block joins two).
CHUNK = 2048
MAX_BROADCAST = 500_000
#: Members of a component that meet others first, at each shingle.
PROBES = 2
#: Entries that are put into one group of third-step blocks, on average.
GROUP_ENTRIES = 20_000
#: Pairs of a group's members that a task counts at a time, about, and members of a chunk where there may be more.
PAIRS, MET = 1 << 20, 1024
#: Bits of the bitmaps that go with a shingle's members.
MEMBER_BITS = 256
#: Bits that are kept of a prefix shingle beyond those that number all shingles. Fewer only make
#: more pairs look alike.
SPARE_BITS = 8
#: Prefix shingles that a task packs at a time, and that a partition of them holds, at least.
PACKED, PART = 1 << 20, 1 << 20


def sets_of(text_column, k: int):
    """Yield (first row, sets, offsets) for runs of about 1 MB of text."""
    data, offs = text_buffers(text_column)
    for i, j in row_slices(offs, 1 << 20):
        part = offs[i : j + 1]
        yield i, *shingle_sets(*word_hashes(data[part[0] : part[-1]], part - part[0]), k)


def planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: what they have in common costs next to nothing."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(raw.tobytes(), "zstd", asbytes=True)


def unplaned(raw: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, n).T).view("<u8").ravel()


def rarity(docs: DataFrame, text_col: str, k: int) -> tuple[np.ndarray, int]:
    """Documents with a shingle of each of 2**SKETCH_BITS hash cells, at most 65,535 (8 MB,
    whatever the input), and the number of all shingles."""
    cells = 1 << SKETCH_BITS
    part = cells // SKETCH_SLICES
    schema = "slot int, node int, shingles long, sums binary"

    def count(batches):
        sums, total = np.zeros(cells, np.uint32), 0
        for b in batches:
            for _, sets, _ in sets_of(b.column("__text"), k):
                found, times = np.unique((sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                sums[found] += times.astype(np.uint32)
                total += len(sets)
        sums = np.minimum(sums, 65535).reshape(SKETCH_SLICES, part)
        node = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SKETCH_SLICES), pa.int32()), pa.array([node] * SKETCH_SLICES, pa.int32()), pa.array([total] + [0] * (SKETCH_SLICES - 1), pa.int64()), pa.array([planes(x) for x in sums], pa.binary())],
            names=["slot", "node", "shingles", "sums"],
        )

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(part, np.uint64)
        for raw in t["sums"]:
            total += unplaned(raw.as_py(), part)
        return pa.table({"slot": t["slot"][:1], "node": t["node"][:1], "shingles": pa.array([sum(t["shingles"].to_pylist())], pa.int64()), "sums": pa.array([planes(np.minimum(total, 65535))], pa.binary())})

    texts = docs.select(F.col(text_col).alias("__text"))
    rows = merged_by_tree(texts.mapInArrow(count, schema), texts.rdd.getNumPartitions(), add, schema).collect()
    out = np.zeros((SKETCH_SLICES, part), np.uint16)
    for r in rows:
        out[r["slot"]] = unplaned(bytes(r["sums"]), part)
    return out.ravel(), sum(r["shingles"] for r in rows)


def keys(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, sketch, cut: int) -> DataFrame:
    """id, n (size of the set), digest (of the set), its minimum hashes a0 to a3, its bitmap
    and rare: its rarest shingles (n - ceil(percent n / 100) + 1: a set that links shares
    one of them) in the order of rarity, of each hash the first `cut` bits.
    sketch: a broadcast of fixed size."""
    salts = mix(np.arange(1, ANCHORS + 1, dtype=np.uint64))
    wide = -(-cut // 8)

    def run(batches):
        for b in batches:
            n, digests, bits, rare, anchors = [], [], [], [], [[] for _ in salts]
            for _, sets, offs in sets_of(b.column("__text"), k):
                salted = [mix(sets ^ s) for s in salts]
                counts = sketch.value[(sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = (sets >> np.uint64(64 - cut)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]
                for a, z in zip(offs[:-1], offs[1:]):
                    m, s = int(z - a), sets[a:z]
                    n.append(m)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    for out, x in zip(anchors, salted):
                        out.append(int(x[a:z].min().view(np.int64)) if m else None)
                    take = m - -(-percent * m // 100) + 1 if m else 0
                    rare.append(first[a + np.argsort(counts[a:z], kind="stable")[:take]].tobytes())
                    bits.append(bitmap(s, MEMBER_BITS).tobytes())
            cols = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), *(pa.array(x, pa.int64()) for x in anchors), pa.array(bits, pa.binary()), pa.array(rare, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("__id"), *cols], names=["id", "n", "digest", *(f"a{i}" for i in range(ANCHORS)), "bits", "rare"])

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, "id long, n long, digest binary, " + "".join(f"a{i} long, " for i in range(ANCHORS)) + "bits binary, rare binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """On sorted distinct hashes."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def spanning_links(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Verified links (places in sets) that join all labels of a block which links join."""
    bits = width(max(map(len, sets)))
    tree = SignatureTree(np.stack([bitmap(s, bits) for s in sets]), np.array([len(s) for s in sets]))
    labels, found = labels.copy(), []
    for i, j in tree.pairs(percent, labels, live=True):
        for a, b in zip(i.tolist(), j.tolist()):
            if labels[a] != labels[b] and linked(sets[a], sets[b], percent):
                found.append((a, b))
                labels[labels == max(labels[a], labels[b])] = min(labels[a], labels[b])
    return found


def block_links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, k: int, percent: int, few: bool) -> tuple[DataFrame, int, int]:
    """a, b: components that verified links join inside groups of members (cid, comp, band) which
    hold several components; the size of the largest group, and the number of texts sent. A large group is dealt into
    blocks. few: only some members of each component in a group."""
    counted = lambda rows: rows.groupBy(F.col("band").alias("g_band")).agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("g_band", "m")
    made = [written(counted(members), "join-groups")]
    members = members.join(checked_broadcast(made[0], MAX_BROADCAST), F.col("band") == F.col("g_band"))
    if few:
        order = F.xxhash64("cid")
        some = F.array_distinct(F.array(F.min("cid"), F.max("cid"), F.min_by("cid", order), F.max_by("cid", order)))
        some = members.groupBy("band", "comp").agg(some.alias("some")).select(F.explode("some").alias("cid"), "comp", "band")
        made += [some := written(some, "join-some"), groups := written(counted(some), "join-groups")]
        members = some.join(checked_broadcast(groups, MAX_BROADCAST), F.col("band") == F.col("g_band"))
    largest = made[-1].agg(F.max("m")).first()[0] or 0
    blocks = F.ceil(F.col("m") / BLOCK)
    dealt = members.select("cid", "comp", "band", F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("block"))
    need = written(dealt.groupBy("cid", "comp").agg(F.collect_list(F.struct("band", "block")).alias("blocks")), "join-blocks")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bloom = Bloom(need, "cid")
    rows = bloom.filtered(texts, F.col("id")).join(checked_broadcast(need, MAX_BROADCAST), F.col("id") == F.col("cid"))
    rows = rows.select("cid", "comp", "text", F.explode("blocks").alias("b")).select("cid", "comp", "text", "b.*")

    def links(t: pa.Table) -> pa.Table:
        comp, sets = t["comp"].to_numpy(), []
        for _, s, offs in sets_of(t["text"], k):
            sets += [s[a:z] for a, z in zip(offs[:-1], offs[1:])]
        good = [i for i, s in enumerate(sets) if len(s)]
        found = spanning_links([sets[i] for i in good], comp[good], percent) if len(good) > 1 else []
        return pa.table({"a": pa.array([int(comp[good[a]]) for a, _ in found], pa.int64()), "b": pa.array([int(comp[good[b]]) for _, b in found], pa.int64())})

    out = written(rows.groupBy("band", "block").applyInArrow(links, "a long, b long"), "join-links")
    bloom.close()
    sent = need.agg(F.sum(F.size("blocks"))).first()[0] or 0
    removed(docs.sparkSession, [need, *made])
    return out, largest, sent


def contracted(state: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """state with the components that links (a, b: components of state) make of its own."""
    if links.isEmpty():
        return state
    found = components(links)
    joined = state.join(checked_broadcast(found, MAX_BROADCAST), F.col("comp") == F.col("node"), "left")
    out = written(joined.select(*(F.coalesce("component", "comp").alias(c) if c == "comp" else F.col(c) for c in state.columns)), name)
    removed(state.sparkSession, [found, state])
    return out


def first_steps(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """cid, comp: components of the classes by links between those that share minimum hashes."""
    state = written(classes.select("cid", F.col("cid").alias("comp"), *(f"a{i}" for i in range(ANCHORS))), "join-state")
    bands = [F.xxhash64(F.lit(i), F.lit(j), F.col(f"a{i}"), F.col(f"a{j}")) for i in range(ANCHORS) for j in range(i + 1, ANCHORS)]
    links, largest, _ = block_links(docs, state.select("cid", "comp", bands[0].alias("band")), id_col, text_col, k, percent, False)
    state = contracted(state, links, "join-state")
    again = True
    while again:
        # The first band again only where its groups had several blocks.
        members = state.select("cid", "comp", F.explode(F.array(*bands[largest <= BLOCK :])).alias("band"))
        links, largest, sent = block_links(docs, members, id_col, text_col, k, percent, True)
        # Groups of several blocks have members that haven't met: again, as long as that helps.
        again = largest > BLOCK and links.count() * 16 > sent
        state = contracted(state, links, "join-state")
    return state.select("cid", "comp")


def packed_prefixes(pre: DataFrame, cut: int, parts: int) -> DataFrame:
    """part and packed entries (shingle, class, component) of a part of the hash range, sorted by
    shingle, for each run of prefixes."""
    wide = -(-cut // 8)

    def pack(run: list) -> pa.RecordBatch:
        tok, cid, comp = (np.concatenate(x) for x in zip(*run))
        by = np.argsort(tok, kind="stable")
        tok, cid, comp = tok[by], cid[by], comp[by]
        at = np.searchsorted(tok, np.arange(parts + 1, dtype=np.uint64) * np.uint64(-(-(1 << cut) // parts)))
        some = np.flatnonzero(np.diff(at))
        cols: list[list] = [[] for _ in range(4)]
        for p in some:
            s = slice(at[p], at[p + 1])
            for c, x in zip(cols, (int(at[p + 1] - at[p]), planes(np.diff(tok[s], prepend=np.uint64(0))), planes(cid[s]), planes(cid[s] - comp[s]))):
                c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "m", "tok", "cid", "off"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for cid, comp, raw in zip(b.column("cid").to_pylist(), b.column("comp").to_pylist(), b.column("rare").to_pylist()):
                n = len(raw) // wide
                full = np.zeros((n, 8), np.uint8)
                full[:, :wide] = np.frombuffer(raw, np.uint8).reshape(n, wide)
                tok = full.view("<u8").ravel()
                held.append((tok, np.full(n, cid, np.int64), np.full(n, comp, np.int64)))
                size += n
                if size >= PACKED:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    return pre.select("cid", "comp", "rare").where(F.length("rare") > 0).mapInArrow(run, "part long, m long, tok binary, cid binary, off binary")


def joining_entries(pre: DataFrame, cut: int, tokens: int) -> DataFrame:
    """tok, cid, m (members of the token) and home (the smallest) of shingles that join different
    components; two shingles of a set whose first bits are equal are two entries, so that what
    sets share is never counted too low; probe: one of the first of its component there; mixed: the token has members
    that aren't."""
    tasks = pre.rdd.getNumPartitions()
    # A part grows with the number of tasks, so that what each sends it isn't next to nothing.
    parts = int(min(1 << 20, max(1, -(-tokens // max(PART, 64 * tasks)))))

    def shared(t: pa.Table) -> pa.Table:
        tok, cid, comp = [], [], []
        for m, a, b, c in zip(*(t[x].to_pylist() for x in ("m", "tok", "cid", "off"))):
            tok.append(np.cumsum(unplaned(a, m), dtype=np.uint64))
            cid.append(unplaned(b, m).view(np.int64))
            comp.append(cid[-1] - unplaned(c, m).view(np.int64))
        tok, cid, comp = map(np.concatenate, (tok, cid, comp))
        by = np.argsort(tok, kind="stable")
        tok, cid, comp = tok[by], cid[by], comp[by]
        cut_at = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
        count = np.diff(np.append(cut_at, len(tok)))
        several = np.minimum.reduceat(comp, cut_at) != np.maximum.reduceat(comp, cut_at)
        keep = np.repeat(several, count)
        tok, cid, comp, m = tok[keep], cid[keep], comp[keep], np.repeat(count, count)[keep]
        by = np.lexsort((cid, mix(cid.view(np.uint64)), comp, tok))
        tok, cid, comp, m = tok[by], cid[by], comp[by], m[by]
        cut_at = np.flatnonzero(np.concatenate(([True], (tok[1:] != tok[:-1]) | (comp[1:] != comp[:-1]))))
        size = np.diff(np.append(cut_at, len(tok)))
        first = np.arange(len(tok)) - np.repeat(cut_at, size) < PROBES
        head, group = np.unique(tok, return_index=True, return_inverse=True)[1:]
        mixed = np.bincount(group, ~first)[group] > 0
        home = np.minimum.reduceat(cid, head)[group] if len(cid) else cid
        return pa.table({"tok": pa.array(tok.view(np.int64)), "cid": pa.array(cid), "m": pa.array(m), "home": pa.array(home), "probe": pa.array(first), "mixed": pa.array(mixed)})

    return packed_prefixes(pre, cut, parts).groupBy("part").applyInArrow(shared, "tok long, cid long, m long, home long, probe boolean, mixed boolean")


def needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Of the shingles that a link of sets of these sizes shares, in the order of rarity, so many
    at least lie in both prefixes."""
    return -(-(na + nb) * percent // (100 + percent)) - -(-np.maximum(na, nb) * percent // 100) + 1


class PairCounts:
    """Numbers of pairs with how often each has come, and how often as a complete one. What has come
    is counted whenever it is as much as what is known, so that repeats take no room."""

    def __init__(self):
        self.key, self.shared, self.whole = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple] = []
        self.size = 0

    def add(self, key: np.ndarray, complete: np.ndarray) -> None:
        self.new.append((key, complete))
        self.size += len(key)
        if self.size >= max(PAIRS, len(self.key)):
            self.settle()

    def settle(self) -> None:
        if not self.size:
            return
        key = np.concatenate([self.key, *(k for k, _ in self.new)])
        shared = np.concatenate([self.shared, np.ones(self.size, np.int64)])
        whole = np.concatenate([self.whole, *(c for _, c in self.new)]).astype(np.int64)
        by = np.argsort(key, kind="stable")
        key = key[by]
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        self.key, self.shared, self.whole = key[cut], np.add.reduceat(shared[by], cut), np.add.reduceat(whole[by], cut)
        self.new, self.size = [], 0


def candidates(tok, ids, comp, sizes, complete, total, raw_bits, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, component of a, of b, size of a, of b, tokens shared, of these complete) of members of
    different components that share a token and may link, by trees over each token's members.
    complete: all members of the token that meet anywhere meet here. total: tokens of a member
    in all groups. Pairs that can't come to enough are left out. Where there may be many pairs,
    members are dealt into chunks, and each two chunks' pairs are counted and given by themselves."""
    bits = np.frombuffer(b"".join(raw_bits), np.uint64).reshape(len(tok), -1)
    _, group, times = np.unique(tok, return_inverse=True, return_counts=True)
    group = group.ravel()
    by = np.lexsort((sizes, ids))
    new = np.concatenate(([True], (ids[by][1:] != ids[by][:-1]) | (sizes[by][1:] != sizes[by][:-1])))[: len(by)]
    first = by[new]  # an entry of each member
    member = np.empty(len(ids), np.int64)
    member[by] = np.cumsum(new) - 1
    own, count = np.unique(np.unique(np.stack((ids, group, complete)), axis=1)[::2], axis=1, return_counts=True)
    own, count = own[0][own[1] > 0], count[own[1] > 0]
    here = np.zeros(len(ids), np.int64)
    if len(own):
        place = np.minimum(np.searchsorted(own, ids), len(own) - 1)
        here = np.where(own[place] == ids, count[place], 0)
    elsewhere = total - here
    n = len(first)
    chunks = 1 if min(int((times * (times - 1) // 2).sum()), n * (n - 1) // 2) <= PAIRS else -(-n // MET)
    chunk = member * chunks // max(n, 1)
    for p in range(chunks):
        for q in range(p, chunks):
            some = np.flatnonzero((chunk == p) | (chunk == q))
            counts = PairCounts()
            for i, j in SignatureTree(bits[some], sizes[some], group[some]).pairs(percent, comp[some]):
                i, j = some[i], some[j]
                good = (comp[i] != comp[j]) & (ids[i] != ids[j]) & ((p == q) | (chunk[i] != chunk[j]))
                i, j = i[good], j[good]
                counts.add(np.minimum(member[i], member[j]) * n + np.maximum(member[i], member[j]), complete[i])
            counts.settle()
            a, b = first[counts.key // max(n, 1)], first[counts.key % max(n, 1)]
            enough = counts.whole + np.minimum(elsewhere[a], elsewhere[b]) >= needed(sizes[a], sizes[b], percent)
            a, b = a[enough], b[enough]
            yield ids[a], ids[b], comp[a], comp[b], sizes[a], sizes[b], counts.shared[enough], counts.whole[enough]


def met(kept: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """a, b, lo, hi, na, nb, shared, whole: pairs of entries that meet in trees, each once, with the
    components and sizes of both and the tokens that they share (whole: complete ones)."""
    # Tokens of one home go to one group, unless they have too many entries.
    homes = kept.groupBy(F.col("home").alias("h_home")).agg(F.count(F.lit(1)).alias("h")).where(F.col("h") > 4 * GROUP_ENTRIES)
    homes = checked_broadcast(written(homes, "join-homes"), MAX_BROADCAST)
    split = F.ceil(F.coalesce("h", F.lit(1)) / GROUP_ENTRIES).cast("int")
    rows = kept.join(homes, F.col("home") == F.col("h_home"), "left").withColumn("group", F.xxhash64("home", F.pmod(F.xxhash64("tok"), split)))
    groups = max(1, -(-kept.count() // GROUP_ENTRIES))
    # A frequent token's entries are dealt into chunks, and each pair of chunks is a block.
    rows = rows.withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j")))
    rows = rows.join(about, F.col("cid") == F.col("p_cid")).select("group", "tok", "cid", "comp", "n", "complete", "total", "bits", "chunks", F.explode(sides).alias("p"))
    group = F.when(F.col("chunks") == 1, F.pmod("group", F.lit(groups))).otherwise(-1 - F.pmod(F.xxhash64("tok", "p"), F.lit(1 << 40)))
    rows = rows.select(group.alias("grp"), "tok", "cid", "comp", "n", "complete", "total", "bits")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        for found in candidates(*(t[c].to_numpy() for c in ("tok", "cid", "comp", "n", "complete", "total")), t["bits"].to_pylist(), percent):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["a", "b", "ca", "cb", "na", "nb", "shared", "whole"])

    pair = rows.groupBy("grp").applyInArrow(pairs, "a long, b long, ca long, cb long, na long, nb long, shared long, whole long")
    return pair.groupBy("a", "b", F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi"), "na", "nb").agg(F.sum("shared").alias("shared"), F.sum("whole").alias("whole"))


def third_step(docs: DataFrame, known: DataFrame, comps: DataFrame, id_col: str, text_col: str, k: int, percent: int, cut: int) -> tuple[DataFrame, DataFrame]:
    """comps (cid, comp) with what first tries join, and a, b: the verified links between those."""
    spark = docs.sparkSession
    pre = known.join(checked_broadcast(comps, MAX_BROADCAST), F.col("id") == F.col("cid")).select("cid", "comp", "n", "bits", "rare")
    pre = written(pre, "join-prefixes")
    tokens = pre.agg(F.sum(F.length("rare"))).first()[0] or 0
    kept = written(joining_entries(pre, cut, tokens // -(-cut // 8)), "join-entries")
    enough = F.expr(f"shared > ((na + nb) * {percent} + {99 + percent}) div {100 + percent} - (greatest(na, nb) * {percent} + 99) div 100")  # needed()
    totals = kept.groupBy(F.col("cid").alias("t_cid")).agg(F.count(F.lit(1)).alias("total"))
    about = pre.select(F.col("cid").alias("p_cid"), "comp", "n", "bits").join(totals, F.col("p_cid") == F.col("t_cid")).drop("t_cid")
    pair = written(met(kept.where("probe").withColumn("complete", ~F.col("mixed")), about, percent), "join-pairs")
    one, order = F.struct("a", "b"), F.xxhash64("a", "b")
    few = F.array_distinct(F.array(F.max_by(one, F.col("shared") * 1024 + F.pmod(order, F.lit(1024))), F.min_by(one, order), F.max_by(one, order), F.max(one)))
    tried = pair.where(enough | (F.col("shared") > F.col("whole"))).groupBy("lo", "hi").agg(few.alias("few")).select("lo", "hi", F.explode("few").alias("p"))
    tried = written(tried.select("lo", "hi", "p.*"), "join-tried")
    links = verified(docs, tried, id_col, text_col, k, percent)
    comps = contracted(comps, links, "join-state")
    about = about.drop("comp").join(comps, F.col("p_cid") == F.col("cid")).drop("cid")
    side = lambda c: checked_broadcast(comps, MAX_BROADCAST).select(F.col("cid").alias(f"{c}_cid"), F.col("comp").alias(f"{c}_comp"))
    seen = pair.where("whole > 0").select("a", "b", "na", "nb", F.col("whole").alias("shared"))
    more = met(kept.where("mixed").withColumn("complete", F.lit(True)), about, percent).select("a", "b", "na", "nb", "shared")
    rest = seen.union(more).groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared")).where(enough).select("a", "b").distinct()
    rest = rest.join(tried.select(F.col("a").alias("t_a"), F.col("b").alias("t_b")), (F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b")), "left_anti")
    rest = rest.join(side("a"), F.col("a") == F.col("a_cid")).join(side("b"), F.col("b") == F.col("b_cid")).where("a_comp <> b_comp")
    more = verified(docs, rest.select("a", "b", F.col("a_comp").alias("lo"), F.col("b_comp").alias("hi")), id_col, text_col, k, percent)
    removed(spark, [pre, kept, pair, tried, links])
    return comps, more


def verified(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """a, b: the components (lo, hi) of pairs (a, b) whose sets link. Each text meets a run of its
    pairs' other texts. If an id repeats, any of its texts may link."""
    pairs = written(pairs, "join-tries")
    runs = written(pairs.groupBy(F.col("a").alias("r_a")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("runs")), "join-runs")
    run_of = F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("run")
    dealt = pairs.join(checked_broadcast(runs.where("runs > 1"), MAX_BROADCAST), F.col("a") == F.col("r_a"), "left").withColumn("runs", F.coalesce("runs", F.lit(1))).select("a", "b", "lo", "hi", run_of)
    heads = runs.select(F.col("r_a").alias("end"), F.col("r_a").alias("a"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"))
    heads = heads.select("end", "a", "run", F.lit(0).alias("nth"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    side = written(heads.union(dealt.select(F.col("b").alias("end"), "a", "run", F.lit(1).alias("nth"), "lo", "hi")), "join-sides")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bloom = Bloom(side, "end")
    rows = bloom.filtered(texts, F.col("id")).join(checked_broadcast(side, MAX_BROADCAST), F.col("id") == F.col("end")).select("a", "run", "nth", "end", "lo", "hi", "text")

    def run(batches):
        at, heads, seen = None, [], set()
        for b in batches:
            sets = []
            for _, s, offs in sets_of(b.column("text"), k):
                sets += [s[x:y] for x, y in zip(offs[:-1], offs[1:])]
            out = []
            for a, r, nth, lo, hi, s in zip(*(b.column(c).to_pylist() for c in ("a", "run", "nth", "lo", "hi")), sets):
                if at != (a, r):
                    at, heads, seen = (a, r), [], set()
                if not nth:
                    heads.append(s)
                elif len(s) and (lo, hi) not in seen and any(len(h) and linked(h, s, percent) for h in heads):
                    seen.add((lo, hi))
                    out.append((lo, hi))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    out = written(rows.repartition("a", "run").sortWithinPartitions("a", "run", "nth", "end").mapInArrow(run, "a long, b long"), "join-more")
    bloom.close()
    removed(docs.sparkSession, [pairs, runs, side])
    return out


def completed(known: DataFrame, some: DataFrame, classes: DataFrame, comps: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """id, n_shingles and component_id of the rows of known (id, n, digest). some: those with an id
    and a set; classes: digest, cid; comps: cid, comp; links: a, b, between components. The
    rows of an id are one document. Deletes the tables that it is given."""
    same_id = some.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select(F.col("id").alias("s_id"))
    same_id = written(same_id, "join-repeated")
    if not same_id.isEmpty():
        repeated = some.join(same_id, F.col("id") == F.col("s_id"), "left_semi").select("id", F.col("digest").alias("r_digest"))
        repeated = repeated.join(classes, F.col("r_digest") == F.col("digest")).join(comps.withColumnRenamed("cid", "c_cid"), F.col("cid") == F.col("c_cid")).select("id", F.col("comp").alias("a"))
        least = repeated.groupBy(F.col("id").alias("l_id")).agg(F.min("a").alias("b"))
        links = links.union(repeated.join(least, F.col("id") == F.col("l_id")).select("a", "b"))
    comps = contracted(comps, links, "join-state")
    # A component is known by the smallest of its classes' ids, and a class by the smallest of its rows'.
    reached = classes.select("digest", "cid").join(comps.withColumnRenamed("cid", "c_cid"), F.col("cid") == F.col("c_cid")).select(F.col("digest").alias("c_digest"), F.col("comp").alias("component"))
    rows = known.select("id", "n", "digest").join(reached, (F.col("digest") == F.col("c_digest")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    rows = rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    out = written(rows, "join-rows")
    removed(known.sparkSession, [known, classes, comps, links, same_id])
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each input row: id, n_shingles, component_id (the smallest id that links
    reach, itself included).

    Texts are split at ASCII white space, with A-Z lowered; a text of fewer words than a
    shingle has its whole sequence as one. Two documents link when 100 * intersection >=
    percent * union of their sets (percent: 50 to 100). Null and empty texts have no
    shingles and no links. A row with a null id has no links and a null component. Rows
    that repeat an id are one document: it has the links of each. Whole texts are read,
    however long. An empty table gives an empty result; other columns are ignored.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    if not 1 <= words <= MAX_WORDS:
        raise ValueError(f"words must lie between 1 and {MAX_WORDS}")
    spark = docs.sparkSession
    bounded_batches(spark)
    sketch, shingles = rarity(docs, text_col, words)
    sent = spark.sparkContext.broadcast(sketch)  # of fixed size
    cut = min(48, shingles.bit_length() + SPARE_BITS)
    known = written(keys(docs, id_col, text_col, words, percent, sent, cut), "join-keys")
    sent.destroy()
    some = known.where("id is not null and n > 0")
    of_class = [F.min("id").alias("cid"), *(F.min(f"a{i}").alias(f"a{i}") for i in range(ANCHORS))]
    classes = written(some.groupBy("digest").agg(*of_class), "join-classes")
    comps = first_steps(docs, classes.dropDuplicates(["cid"]), id_col, text_col, words, percent)
    comps, links = third_step(docs, some, comps, id_col, text_col, words, percent, cut)
    return completed(known, some, classes, comps, links, id_col)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs, with their columns, without rows that link to one of a smaller id, at any
    remove: the smallest of each group stays."""
    found = near_duplicates(docs, id_col, text_col, words, percent)
    dropped = written(found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("__drop")), "join-dropped")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))  # so that no name can clash
    return rows.join(checked_broadcast(dropped, MAX_BROADCAST), F.col("__row")[id_col] == F.col("__drop"), "left_anti").select("__row.*")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
"""
