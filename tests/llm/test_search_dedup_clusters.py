"""Ranked search, min-max near-dedup and clusters against brute force, with nulls, empty tables,
ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweir.llm import centroids, lexical, minmax, ngram_join
from codeweir.llm import components as components_of
from codeweir.llm.components import components
from tests.llm.test_operators import brute_links, docs, near_copies, random_texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


# --- 11 ----------------------------------------------------------------------------


def brute_search(rows, items, top=50):
    terms = lambda text: TERM.findall((text or "").translate(LOWER))
    counted = [(i, Counter(terms(t))) for i, t in rows]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            if i is None:
                continue
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in items], "item_id long, text string, rank string, score long")


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    if small:  # several blocks of items, parts of a run, heaps in several ranges
        monkeypatch.setattr(lexical, "BLOCK_TERMS", 8)
        monkeypatch.setattr(lexical, "ENTRIES", 16)
        monkeypatch.setattr(lexical, "HELD", 10)
    texts = random_texts(31, 160, 30, 50)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    rows += [(2000, None), (2001, ""), (2002, " .,;\x00"), (None, texts[1]), (5000, texts[1]), (4000, texts[1]), (4000, texts[1])]  # ties and repeats
    rows += [(6000, "W1 w1-w2_w3 Élan ÉLAN w1\x7fw4 中文 w1" * 3), (6001, "w5 " * 30_000 + "w6")]
    items = [(1, "w1 W2 w3"), (1, "w4 w4 w5"), (2, "élan 中文 Élan"), (3, None), (4, " . "), (None, "w9 w6 w1"), (5, "absent"), (6, texts[3])]
    got = lexical.search(docs(spark, rows).repartition(5), items_of(spark, items), top=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(rows, items, 7)


def test_search_of_nothing(spark):
    some, none = docs(spark, [(1, "a b"), (2, None)]), docs(spark, [(1, "a")]).where("false")
    asked = items_of(spark, [(1, "a b"), (2, "")])
    assert lexical.search(none, asked).count() == 0
    assert lexical.search(some, asked.where("false")).count() == 0
    assert lexical.search(docs(spark, [(1, None), (2, " ")]), asked).count() == 0
    # The only document has every term: ln(4 / 3) is above 0, so it is found.
    assert [tuple(r) for r in lexical.search(some, asked).collect()] == brute_search([(1, "a b")], [(1, "a b")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=200))
def test_radix_order_is_a_stable_sort(keys):
    keys = np.array(keys, np.uint64)
    assert lexical.radix_order(keys).tolist() == np.argsort(keys, kind="stable").tolist()


# --- 12 ----------------------------------------------------------------------------


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_min_max_equals_brute_force(spark, monkeypatch, k, percent):
    monkeypatch.setattr(minmax, "CHUNK", 300)
    monkeypatch.setattr(minmax, "GROUP", 2000)
    rows = near_copies(k + 40) + [(2000 + i, t) for i, t in enumerate(random_texts(3, 40, 6, 8))] + [(3000, None), (3001, ""), (3002, " \t"), (3003, "one two"), (3004, "One\x0bTWO")]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minmax.near_copies(docs(spark, rows), words=k, percent=percent).collect()}
    assert got == {i: (c, c == i) for i, c in brute_links(rows, k, percent).items()}


def test_min_max_second_step_alone_finds_all(spark, monkeypatch):
    """Without hubs, blocks of signatures give every link of a family about the threshold."""
    monkeypatch.setattr(minmax, "ROUNDS", 0)
    monkeypatch.setattr(minmax, "CHUNK", 1200)
    rng = random.Random(8)
    base = [f"b{rng.randint(0, 5000)}" for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 99999)}"
        rows.append((i * 13 % 997, " ".join(w)))
    want = brute_links(rows, 3, 85)
    assert 1 < len(set(want.values())) < len(rows)
    assert {r["doc_id"]: r["component_id"] for r in minmax.near_copies(docs(spark, rows), words=3, percent=85).collect()} == want


def test_min_max_rounds_need_few_shuffles(spark, monkeypatch):
    """A round of hubs joins components by one round of stars, whose edges are kept, not to their end."""
    ended, names = [], []
    whole, kept = ngram_join.components, minmax.written
    monkeypatch.setattr(ngram_join, "components", lambda links: ended.append(1) or whole(links))
    monkeypatch.setattr(minmax, "written", lambda df, name: names.append(name) or kept(df, name))
    rows = near_copies(43)
    got = {r["doc_id"]: r["component_id"] for r in minmax.near_copies(docs(spark, rows), words=3, percent=85).collect()}
    assert got == brute_links(rows, 3, 85)
    assert ended == [1] and names.count("minmax-labels") > 0


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    links = chain + [(5, i) for i in range(60, 90)] + [(1, 2), (2, 3), (3, 1), (9, 9), (2, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 5 for i in (5, *range(60, 90))} | {1: 1, 2: 1, 3: 1}


def test_components_that_are_stars_need_no_round(spark, monkeypatch):
    monkeypatch.setattr(components_of, "star_round", None)
    assert {tuple(r) for r in components(spark.createDataFrame([(3, 1), (1, 2), (7, 6)], "a long, b long")).collect()} == {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)}


def test_min_max_of_nulls_repeats_long_texts_and_nothing(spark):
    long = " ".join(f"v{i % 70_000}" for i in range(150_000))
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "q r s t u v"), (9, "q r s t u v"), (7, "a b c d e f"), (20, long), (21, long + " end")]
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minmax.near_copies(docs(spark, rows)).collect() if r["doc_id"])
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (20, 20, True), (21, 20, False)]
    assert [(r["component_id"], r["kept"]) for r in minmax.near_copies(docs(spark, rows[:1])).collect()] == [(None, True)]
    assert minmax.near_copies(docs(spark, rows).where("false")).count() == 0


def test_bands_miss_no_more_than_said():
    """The probability that no neighbours in a circle agree, against a count over all outcomes."""
    for percent in (80, 85):
        p, n = minmax.agreement(percent), 12
        missed = sum(p ** bin(x).count("1") * (1 - p) ** (n - bin(x).count("1")) for x in range(1 << n) if not x & (x << 1 | x >> n - 1) & (1 << n) - 1)
        root = np.sqrt((1 - p) ** 2 + 4 * p * (1 - p))
        assert abs(missed - (((1 - p + root) / 2) ** n + ((1 - p - root) / 2) ** n)) < 1e-12
        assert minmax.permutations(percent) < 80


def test_min_max_estimates_similarity():
    """Means of agreeing values come to the similarity, with less spread than separate minima."""
    from codeweir.llm.common import mix

    rng, found, split = np.random.default_rng(4), [], []
    for _ in range(300):
        x = mix(rng.integers(0, 1 << 62, 60).astype(np.uint64))
        a, b = np.sort(x[:50]), np.sort(x[10:])  # 40 of 60
        ends = minmax.min_max(np.concatenate((a, b)), np.array([0, 50, 100]), 32)
        found.append((ends[0] == ends[1]).mean())
        split.append((ends[0, :, 0] == ends[1, :, 0]).mean())
    assert abs(np.mean(found) - 40 / 60) < 0.02 and np.var(found) < np.var(split)


# --- 13 ----------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dim, seed="1:"):
    kept = [(i, [math.floor(64 * float(np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [list(v) for _, v in order[:k]]
    if not cs:
        return []
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                cs[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in found]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string")


@pytest.mark.parametrize("spread", [0.004, 0.05, 3.0])
def test_clusters_equal_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(centroids, "RUN", 7)
    rng = np.random.default_rng(int(spread * 1000))
    heads = rng.normal(0, 1, (6, 4))
    # A small spread makes many ties: components have few distinct integers.
    rows = [(i, (heads[i % 6] * (spread > 0.01) + rng.normal(0, spread, 4)).tolist()) for i in range(240)]
    rows += [(300, None), (301, [1.0, 2.0]), (302, [0.0, None, 1.0, 1.0]), (303, [0.0, float("nan"), 1.0, 1.0]), (304, [float("inf"), 0.0, 0.0, 0.0]), (305, []), (None, [0.0, 0.0, 0.0, 0.0]), (7, rows[7][1]), (7, rows[8][1])]
    got = centroids.clusters(vectors(spark, rows).repartition(3), k=9, dim=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, brute_clusters(rows, 9, 3, 4)))


def test_clusters_of_few_equal_and_no_vectors(spark):
    same = [(i, [0.5, -0.5]) for i in range(40)] + [(99, [1e6, -1e6])]
    for rows in (same, same[:3], same[:1]):
        got = centroids.clusters(vectors(spark, rows), k=16, dim=2)
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, brute_clusters(rows, 16, 3, 2)))
    none = centroids.clusters(vectors(spark, same).where("false"))
    assert none.count() == 0 and none.columns[:3] == ["vec_id", "cluster", "distance"]
    with pytest.raises(Exception, match="too large for exact distances"):
        centroids.clusters(vectors(spark, [(1, [1e9, 0.0])]), dim=2).collect()


def test_bounds_skip_distances(spark):
    """Of well separated groups, later rounds compute few distances."""
    rng = np.random.default_rng(3)
    heads = rng.normal(0, 40, (8, 16))
    rows = [(i, (heads[i % 8] + rng.normal(0, 0.3, 16)).tolist()) for i in range(400)]
    counted = []
    got = centroids.clusters(vectors(spark, rows), k=8, dim=16, counters=counted)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, brute_clusters(rows, 8, 3, 16)))
    assert len(counted) == 3 and counted[-1] < 400 * 8 / 2


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 9), st.integers(1, 5))
def test_assignment_from_loose_bounds_equals_a_plain_search(seed, k, dim):
    """Any bounds that hold, ties included."""
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-3, 4, (50, dim)), rng.integers(-3, 4, (k, dim))
    true = np.stack([centroids.squared(x, y) for y in c], axis=1)
    own = rng.integers(0, k, 50)
    root = np.sqrt(true.astype(float))
    upper = centroids.up(root[np.arange(50), own] + rng.choice([0, 0, 1.5], 50))
    lower = centroids.down(root - rng.choice([0, 0, 0.7], (50, k)))
    got, exact, upper, lower, _ = centroids.assigned(x, c, own, upper, lower)
    assert got.tolist() == true.argmin(1).tolist()
    assert ((exact < 0) | (exact == true.min(1))).all()
    assert (upper >= root[np.arange(50), got]).all() and (lower <= root).all()


def test_search_reads_columns_by_name(spark):
    """Names of the operator's own tables clash with none."""
    rows = docs(spark, [(1, "a b"), (2, "b c")]).select(F.col("doc_id").alias("key"), F.col("text").alias("id"))
    got = lexical.search(rows, items_of(spark, [(9, "c")]), id_col="key", text_col="id")
    assert [(r["item_id"], r["key"]) for r in got.collect()] == [(9, 2)]
