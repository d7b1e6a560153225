"""Query functions without SQL against brute force, on the small tables."""

import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from codeweir.llm import mixing, packing, queries, token_counts, toxicity
from codeweir.llm.common import table, text_buffers
from tests.llm.test_operators import hf

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}


def test_op4_counts_every_token(spark, rows):
    want, t = defaultdict(Counter), hf()
    for r in rows.values():
        text = r["text"] or ""
        want[r["source"], r["lang"]].update(documents=1, tokens=len(t.encode(text, add_special_tokens=False).ids), chars=len(text))
    got = {(r["source"], r["lang"]): (r["documents"], r["tokens"], r["chars"]) for r in token_counts.op4_token_counts(spark, SF).collect()}
    assert got == {k: (c["documents"], c["tokens"], c["chars"]) for k, c in want.items()}


def test_op5_is_the_mix_of_tokens(spark, rows):
    """Against SQL over the lengths that another library's encoder gives."""
    con, t = duckdb.connect(), hf()
    ids = list(rows)
    col = lambda c, kind: pa.array([rows[i][c] for i in ids], kind)
    sizes = pa.array([len(t.encode(rows[i]["text"] or "", add_special_tokens=False).ids) for i in ids], pa.int64())
    con.register("documents", pa.table({"doc_id": pa.array(ids, pa.int64()), "lang": col("lang", pa.string()), "source": col("source", pa.string()), "n_tokens": sizes}))
    found = con.execute(mixing.mix_sql("n_tokens"))
    names = [d[0] for d in found.description]
    got = mixing.op5_mixing(spark, SF)
    assert sorted(names) == sorted(got.columns)
    want = sorted(repr([r[names.index(c)] for c in got.columns]) for r in found.fetchall())
    assert want and sorted(repr(list(r)) for r in got.collect()) == want


def test_words_are_split_at_all_white_space_in_sql(spark):
    con = duckdb.connect()
    texts = ["one\rtwo\x0bthree\x0cfour", " a\tb\n", "", None, "\u00a0x"]
    con.register("documents", pa.table({"doc_id": pa.array(range(5), pa.int64()), "lang": ["en"] * 5, "source": ["src1"] * 5, "text": pa.array(texts, pa.string())}))
    want = sorted(con.execute(mixing.SQL.replace("* 0.6::DOUBLE", "* 1.0::DOUBLE")).fetchall(), key=repr)
    df = spark.createDataFrame([(i, "en", "src1", t) for i, t in enumerate(texts)], "doc_id long, lang string, source string, text string")
    got = mixing.select_mix(df, mixing.Mix(epochs=2, share=1.0), mixing.words())
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and {r[0]: r[5] for r in want} == {0: 4, 1: 2, 2: 0, 3: 0, 4: 1}


def test_op6_is_full_and_follows_the_curve(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_BYTES", 100_000)
    got, t = [r.asDict() for r in packing.op6_packing(spark, SF).collect()], hf()
    sizes = {i: len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for i, r in rows.items()}
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == sizes[r["doc_id"]]
    assert have == sizes
    sequences = defaultdict(int)
    for r in got:
        sequences[r["sequence_id"]] += r["length"]
    ranges = {s >> 32 for s in sequences}
    assert len(ranges) > 3 and max(sequences.values()) <= 1024
    # Only the last sequence of a range has room left.
    assert sum(n < 1024 for n in sequences.values()) <= len(ranges)
    ids = list(rows)
    keys = dict(zip(ids, packing.curve_keys(*text_buffers(pa.array([rows[i]["text"] for i in ids], pa.string())))))
    order = [keys[r["doc_id"]] for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])) if r["start"] == 0]
    assert order == sorted(order) and len(set(order)) > 20


def test_neighbours_on_the_curve_share_words():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"]
    keys, sets = packing.curve_keys(*text_buffers(texts)), [set((x or "").lower().split()) for x in texts.to_pylist()]

    def shared(order):
        order = [i for i in order if sets[i]]
        return np.mean([len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in zip(order, order[1:])])

    by_length = shared(np.argsort([len(x) for x in sets], kind="stable"))
    by_chance = shared(np.random.default_rng(1).permutation(len(sets)))
    assert shared(np.argsort(keys, kind="stable")) > 1.4 * by_length > 1.4 * by_chance


def feature_set(text):
    cols, offs = toxicity.features(*text_buffers(pa.array([text])))
    return set(cols.tolist())


def test_op9_scores_equal_a_plain_loop_over_the_model(spark, rows):
    docs = table(spark, SF, "documents")
    chain = toxicity.train_chain(docs, table(spark, SF, "labels"))
    assert [m for m in chain.names] == ["junk", "toxic"] and len(chain.models[1].extra) == 1
    weights = [dict(zip(m.at.tolist(), m.weights.tolist())) for m in chain.models]
    got = {r["doc_id"]: r for r in toxicity.op9_toxicity(spark, SF).collect()}
    assert set(got) == set(rows)
    for i, r in rows.items():
        text, extras = r["text"] or "", []
        found = feature_set(text)
        for name, m, w in zip(chain.names, chain.models, weights):
            margin = m.bias + sum(w.get(f, 0.0) for f in found) + sum(e * x for e, x in zip(m.extra, extras))
            extras.append(1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))))
            assert abs(got[i][f"p_{name}"] - extras[-1]) < 1e-6
        assert got[i]["toxic"] == (extras[-1] >= 0.5 and text != "")


def test_features_are_those_of_the_words(rows):
    """A text has the features of its words, whatever stands between them."""
    for r in list(rows.values())[:40]:
        words = [w for w in re.split(rb"[^A-Za-z\x80-\xff]+", (r["text"] or "").encode()) if w]
        apart = set().union(*(feature_set(w.decode(errors="surrogateescape")) for w in set(words) if not any(0x80 <= c for c in w)), set())
        assert apart <= feature_set(r["text"] or "")
        if all(c < 0x80 for w in words for c in w):
            assert apart == feature_set(r["text"] or "")


def test_op10_backs_off_where_a_pair_is_seen_once(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": [1, 2, 3], "text": ["a b c", "a b d", None]}), str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.queries()["op10_lm_scores"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert got == sorted(con.execute(queries.oracle_sql()["op10_lm_scores"]).fetchall())
    assert [r[:3] for r in got] == [(1, 3, 1), (2, 3, 1), (3, 0, 0)]


def test_every_query_without_sql_is_tested_here():
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"op4_token_counts", "op5_mixing", "op6_packing", "op9_toxicity"}
    assert np.isfinite(toxicity.THRESHOLD)
