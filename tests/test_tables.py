"""Operators on tables of any size: numbering, relations, many patterns, streams, sources and
sinks."""

import json
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from codeweir.operators import findings as fx
from codeweir.operators.automaton import Automaton, automata, containing
from codeweir.operators.numbering import numbered
from codeweir.operators.relations import related_to_all
from codeweir.sources import json_array
from codeweir.streaming import merging


def test_numbering_is_whole_and_has_no_single_task(spark):
    rows = spark.range(0, 5000, 1, 7).select(F.xxhash64("id").alias("h"), (F.col("id") % 3).alias("g"), "id")
    got = numbered(rows, [F.col("g").desc(), F.col("h"), F.col("id")])
    want = {r["id"]: i for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r["g"], r["h"], r["id"])), 1)}
    assert {r["id"]: r["place"] for r in got.collect()} == want
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert numbered(rows.where("false"), [F.col("h")]).count() == 0
    hot = numbered(spark.range(1000).select(F.lit(1).alias("h")), [F.col("h")], "n", start=0)
    assert sorted(r["n"] for r in hot.collect()) == list(range(1000))


def test_related_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, f"id{rng.randint(0, 30)}" if i % 9 else None, rng.choice(["a", "b", None, "c"]), rng.choice(["x", "y", None])) for i in range(120)]
    rows += [(200 + i, "same", "hot", "x") for i in range(30)] + [(300, "lone", "only", None)]
    df = spark.createDataFrame(rows, "ord long, id string, file string, category string")
    for r in related_to_all(df).collect():
        _, own, file, category = next(x for x in rows if x[0] == r["ord"])
        near = [i for _, i, f, c in rows if i != own and (f == file or (c == category and c is not None))]
        assert (r["n_related"], r["related"]) == (len(near), near[:5]), r
    assert related_to_all(df.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abé中", min_size=1, max_size=4), min_size=1, max_size=12, unique=True), st.lists(st.text(alphabet="abé中 ", max_size=40), min_size=1, max_size=6), st.integers(1, 9), st.sampled_from([64, 300, 1 << 20]))
def test_automata_find_what_contains_finds(patterns, texts, lanes, table):
    import codeweir.operators.automaton as module

    module.LANES, before = lanes, module.LANES
    try:
        made = automata(patterns, table)
        assert all(a.step.nbytes <= max(table, 64) or len(a.ids) >= 1 for a in made)
        data, begin = module._texts(pa.array(texts))
        found = set()
        for a in made:
            ids, place = a.ends(data)
            found |= set(zip((np.searchsorted(begin, place, "right") - 1).tolist(), ids.tolist()))
    finally:
        module.LANES = before
    assert found == {(i, j) for i, t in enumerate(texts) for j, p in enumerate(patterns) if p in t}


def test_containing_many_patterns_nulls_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr("codeweir.operators.automaton.TABLE_BYTES", 4000)
    patterns = ["", "needle", "eed", "hay", "absent", *(f"w{i}x" for i in range(500))]
    texts = [None, "", "hay " * 300_000 + "needle", "w7x w77x w499x", "HAY"]
    df = spark.createDataFrame(list(enumerate(texts)), "found long, text string").withColumnRenamed("found", "n")
    assert len(automata(patterns, 4000)) > 3
    got = {r["n"]: r["hits"] for r in containing(df, "text", patterns, "hits").collect()}
    assert got == {i: [j for j, p in enumerate(patterns) if p and p in (t or "")] for i, t in enumerate(texts)}
    assert containing(df.where("false"), "text", patterns).count() == 0 and containing(df, "text", []).select("found").distinct().count() == 1


def test_automaton_states_are_shared():
    assert len(Automaton([(0, b"abc"), (1, b"abd")]).step) == 5


# --- one JSON array ------------------------------------------------------------------


def read_by_ranges(path, size):
    """What all ranges' tasks read, each by itself."""
    length = os.path.getsize(path)
    does = {(i, x["inside"]): x for i in range(max(1, -(-length // size))) for x in json_array.effects(path, i * size, min(length, (i + 1) * size))}
    parts = json_array.composed(path, length, size, does)
    reader = json_array._Reader(path, [[p.start, p.end, p.inside, p.depth, p.before] for p in parts])
    return [row for p in reader.partitions() for row in reader.read(p)]


_VALUE = st.recursive(st.none() | st.booleans() | st.integers(-5, 99999) | st.text(alphabet='ab\\"[]{},: é\n', max_size=9), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(alphabet='k\\"],', max_size=3), v, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(_VALUE, max_size=8), st.integers(1, 40), st.sampled_from([None, 2]), st.sampled_from(["", " \n"]), st.integers(1, 17))
def test_every_element_is_read_once_whatever_the_ranges(tmp_path_factory, values, size, indent, around, block):
    path = str(tmp_path_factory.mktemp("array") / "a.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(around + json.dumps(values, indent=indent, ensure_ascii=False) + around)
    json_array.BLOCK, before = block, json_array.BLOCK
    try:
        got = read_by_ranges(path, size)
    finally:
        json_array.BLOCK = before
    assert [i for i, _ in got] == list(range(len(values))) and [json.loads(x) for _, x in got] == values


def test_ranges_are_looked_at_in_blocks(tmp_path, monkeypatch):
    path, values = str(tmp_path / "a.json"), [{"a": ['x"\\', [i]]} for i in range(500)]
    (tmp_path / "a.json").write_text(json.dumps(values))
    size, sizes, whole = os.path.getsize(path), [], json_array.structure
    want = json_array.effects(path, 7, size)
    monkeypatch.setattr(json_array, "structure", lambda data, *at: sizes.append(len(data)) or whole(data, *at))
    monkeypatch.setattr(json_array, "BLOCK", 64)
    got = json_array.effects(path, 7, size)
    assert max(sizes) == 64
    said = lambda found: [{**r, "levels": dict(zip(r["levels"], r["count"])), "count": 0} for r in found]
    assert said(got) == said(want)


def test_array_of_broken_text_is_refused(tmp_path):
    (tmp_path / "a.json").write_text('[1, "2')
    with pytest.raises(ValueError, match="no whole JSON array"):
        read_by_ranges(str(tmp_path / "a.json"), 3)


def test_sink_is_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "out.json")
    rows = spark.range(0, 1000, 1, 6).select(F.when(F.col("id") % 100 != 7, F.to_json(F.struct("id"))).alias("value"))
    json_array.write_array(rows, "value", path)
    want = [{"id": i} for i in range(1000) if i % 100 != 7]
    assert json.load(open(path)) == want
    assert [(r["at"], json.loads(r["value"])) for r in json_array.elements(spark, path, 1000).orderBy("at").collect()] == list(enumerate(want))
    assert json_array.elements(spark, path, 1000).rdd.getNumPartitions() > 5
    bad = rows.withColumn("value", F.when(F.col("value").contains("900"), F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception):
        json_array.write_array(bad, "value", path)
    assert json.load(open(path)) == want and os.listdir(tmp_path) == ["out.json"]
    json_array.write_array(rows.where("false"), "value", path)
    assert json.load(open(path)) == [] and json_array.elements(spark, path).count() == 0


# --- merge over a stream --------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.randoms())
def test_state_is_the_same_in_any_order(rng):
    rows = [
        {"ord": rng.randint(0, 5), "tie": i, "severity": rng.choice([*fx.SEVERITIES, None]), "confidence": rng.choice(fx.CONFIDENCES), "source": rng.choice("ab"), "tags": rng.choice([None, [], ["t"], ["u", "t"]]), "score_impact": rng.choice([None, 1.0, 2.0])}
        | {c: f"{c}{i}" for c in merging.FROM_FIRST} | {c: rng.choice([True, False, None]) for c in merging.ANY} | {c: rng.choice([None, f"v{i}"]) for c in merging.FIRST_GIVEN}
        for i in range(6)
    ]

    def state(order):
        held = None
        for r in order:
            held = json.loads(json.dumps(merging.merge_into(held, r)))
        return merging.merged_row(held)

    assert state(rows) == state(rows[::-1]) == state(sorted(rows, key=lambda r: r["source"]))


def test_a_key_takes_rows_and_gives_one():
    """Rows, not a data frame for each key, whose making costs more than the merge of its rows."""
    one = {c: c for c in merging.FROM_FIRST} | {c: None for c in (*merging.FIRST_GIVEN, *merging.ANY)} | {"tie": 0, "severity": "low", "confidence": "high", "source": "a", "tags": ["t"], "score_impact": None}
    merger, held = merging.Merging(None), []
    merger.held = type("Held", (), {"get": lambda self: held[-1] if held else None, "update": lambda self, value: held.append(value)})()
    for ords, first in (([5, 4], 4), ([7, 3], 3)):
        out = list(merger.handleInputRows((), iter([Row(said=json.dumps(one | {"ord": o})) for o in ords]), None))
        assert [json.loads(r["said"])["ord"] for r in out] == [first]
    assert json.loads(held[-1][0])["n"] == 4


def finding(spark, ord, message="m", tags=("t",)):
    return fx.completed(spark.createDataFrame([(ord, f"f{ord}", "ruff", "correctness", "low", "high", "T", message, list(tags))], "ord long, id string, source string, category string, severity string, confidence string, title string, message string, tags array<string>"))


def test_keys_are_forgotten_after_their_time(spark, tmp_path):
    def land(ord, keep):
        finding(spark, ord, tags=(f"t{ord}",)).write.mode("append").parquet(str(tmp_path / f"in{keep}"))
        stream = spark.readStream.schema(finding(spark, 0).schema).parquet(str(tmp_path / f"in{keep}"))
        merging.start(stream, str(tmp_path / f"out{keep}"), str(tmp_path / f"check{keep}"), keep).awaitTermination()
        return [(r["ord"], r["tags"]) for r in spark.read.parquet(str(tmp_path / f"out{keep}")).orderBy("batch").collect()]

    assert land(5, 60_000) == [(5, ["t5"])]
    assert land(3, 60_000) == [(5, ["t5"]), (3, ["t3", "t5"])]
    assert land(5, 500) == [(5, ["t5"])]
    time.sleep(1)
    assert land(9, 500)[1] == (9, ["t9"])


# --- versions, layouts, lines, graphs ----------------------------------------------------


def test_baseline_versions(spark, tmp_path):
    from codeweir.sources import versions

    home = str(tmp_path / "baseline")
    rows = fx.completed(spark.range(300).select(F.col("id").alias("ord"), F.lit("").alias("id"), F.lit("ruff").alias("source"), F.lit("correctness").alias("category"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.lit("m").alias("message")))
    assert versions.versions(spark, home) == [] and versions.flagged(rows, home).where("is_new").count() == 300
    versions.write_version(rows.where("ord < 100"), home, 4)
    versions.write_version(rows.where("ord >= 50 and ord < 250").union(rows.where("ord = 60")), home, 4)
    assert [(v.number, v.rows) for v in versions.versions(spark, home)] == [(1, 100), (2, 200)]
    new = lambda number: {r["ord"] for r in versions.flagged(rows, home, number).where("is_new").collect()}
    assert new(None) == {*range(50), *range(250, 300)} and new(1) == set(range(100, 300))
    for v in versions.versions(spark, home):  # another session doesn't know the tables
        spark.sql(f"DROP TABLE baseline_{v.folder.replace('-', '_')}")
    found = versions.flagged(rows, home)
    assert {r["ord"] for r in found.where("is_new").collect()} == new(2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin") :]
    assert side.count("Exchange") == 1 and "SelectedBucketsCount: 4 out of 4" in found._jdf.queryExecution().toString()


def test_layouts_read_a_table_once_and_never_fail(spark):
    from codeweir.sources import layouts

    raw = [("ruff", '[{"filename":"a.py","location":{"row":"x"},"code":"E1","message":"m"},5,{"code":null}]'), ("pyright", '{"generalDiagnostics":[{"file":"b.py","range":{"start":{"line":0}},"rule":"r","message":"n","severity":"error"}]}'), ("ruff", "no json"), ("pyright", "[]"), ("ruff", None), ("other", "[]"), ("semgrep", '{"results":{}}')]
    found = layouts.findings(spark.createDataFrame(raw, "source string, stdout string"))
    got = sorted((r["source"], r["file"], r["start_line"], r["title"], r["severity"], r["ord"]) for r in found.collect())
    assert got == [("pyright", "b.py", 1, "r", "high", 0), ("ruff", "a.py", None, "E1", "medium", 0)]
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_tool_of_lines_is_registered_and_parsed(spark):
    from codeweir.sources import text_formats, tools

    try:
        text_formats.register_lines("linesmith", r"(?P<file>[^:]+):(?P<line>\d+): (?P<title>\w+): (?P<message>.*)", "correctness", lambda: F.when(F.col("title") == "error", "high").otherwise("low"), agent_instruction="Look.")
        raw = spark.createDataFrame([("linesmith", "a.c:3: error: it's \\ bad\r\nnoise\nb.c:x: warning: w\nb.c:9: warning: w", "", 1, 5, "ok", None), ("linesmith", None, "", 0, 5, "ok", None)], tools.RAW)
        got = [(r["id"], r["severity"], r["message"], r["start_line"], r["agent_instruction"]) for r in tools.parsed(raw, tools=["linesmith"]).orderBy("ord").collect()]
        assert got == [("linesmith:a.c:3:error", "high", "it's \\ bad", 3, "Look."), ("linesmith:b.c:9:warning", "low", "w", 9, "Look.")]
    finally:
        tools.unregister("linesmith")


def test_changed_graph_equals_one_from_nothing(spark):
    from codeweir.operators.graph_changes import begin, changed

    rng = random.Random(12)
    edge = lambda: (rng.randint(0, 29), rng.randint(0, 31))  # noqa: E731  30 and 31 are no nodes
    frame = lambda rows: spark.createDataFrame(sorted(rows), "src long, dst long")
    nodes, have = spark.range(30).select(F.col("id").alias("path")), {edge() for _ in range(28)}
    state = begin(nodes, frame(have), spark.createDataFrame([(0,), (7,)], "path long"))
    for _ in range(2):
        gone, new = set(rng.sample(sorted(have), 6)) | {edge()}, {edge() for _ in range(4)}
        new.add(sorted(gone)[0])  # in both: stays
        have = (have - gone) | new
        state = changed(state, frame(new), frame(gone))
    inside = {(a, b) for a, b in have if b < 30}
    reached = {0, 7}
    while more := {b for a, b in inside if a in reached} - reached:
        reached |= more
    label = {n: n for n in range(30)}
    for _ in range(30):
        for a, b in inside:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["path"] for r in state.reached.collect()} == reached
    assert {r["path"]: r["component"] for r in state.labels.collect()} == label


# --- rules of many projects ------------------------------------------------------------------

_PART = st.sampled_from(["a", "b", "ab", "*", "a*", "?", "**", "[ab]", "{a,b}", "", "*b"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(_PART, min_size=1, max_size=4).map("/".join), min_size=1, max_size=5), st.lists(st.sampled_from(["a", "b", "ab", "c", ""]), min_size=1, max_size=4).map("/".join))
def test_tries_match_what_globs_match(globs, path):
    import re

    from codeweir.functions.text import glob_regex
    from codeweir.operators.path_rules import Trie

    trie = Trie(list(enumerate(globs)))
    assert trie.rules(path) == trie.rules(path) == [i for i, g in enumerate(globs) if re.match(glob_regex(g), path)]


def test_rules_of_projects(spark, monkeypatch):
    from codeweir.operators import path_rules

    monkeypatch.setattr(path_rules, "PATHS", 3)
    paths = [("p", "src/a.ts"), ("p", "src/x/b.ts"), ("p", "lib/c.py"), ("p", None), ("q", "src/a.ts"), ("r", "src/a.ts"), (None, "src/a.ts"), ("p", "src/a.ts"), ("p", "node_modules/a.ts")]
    rules = [("p", 1, "src/**", False), ("p", 2, "**/*.ts", False), ("p", 3, "node_modules/**", True), ("q", 4, "lib/**", False), (None, 5, "**", False), ("q", 6, None, False), ("s", 7, "**", False)]
    df = spark.createDataFrame(paths, "project string, path string")
    known = spark.createDataFrame(rules, "project string, rule long, glob string, exclude boolean")
    got = sorted((r["project"] or "", r["path"] or "", r["rules"]) for r in path_rules.ruled(df, known).collect())
    assert got == [("", "src/a.ts", []), ("p", "", []), ("p", "lib/c.py", []), ("p", "node_modules/a.ts", [2, 3]), ("p", "src/a.ts", [1, 2]), ("p", "src/a.ts", [1, 2]), ("p", "src/x/b.ts", [1, 2]), ("q", "src/a.ts", []), ("r", "src/a.ts", [])]
    assert sorted((r["project"], r["path"]) for r in path_rules.chosen(df, known).collect()) == [("p", "src/a.ts"), ("p", "src/a.ts"), ("p", "src/x/b.ts")]
    assert path_rules.ruled(df.where("false"), known).count() == 0 and path_rules.ruled(df, known.where("false")).count() == 9


def test_url_rules_look_at_each_glob_and_path_once(spark, tmp_path, monkeypatch):
    import duckdb

    import codeweir.table_queries as module
    from codeweir import queries

    urls = [f"https://h{i % 2}.org/{'ab'[i % 2]}/x{i % 5}" for i in range(40)] + ["https://h0.org", "none"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    seen, before = [], module.ruled
    monkeypatch.setattr(module, "ruled", lambda paths, rules: seen.append((paths.count(), rules.count())) or before(paths, rules))
    got = sorted(tuple(r) for r in module.url_rules_pages(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.SQL["url_rules_pages"]).fetchall())
    assert seen[0][0] == 12 and seen[0][1] < 35


def test_closure_makes_its_edges_once(spark):
    from codeweir.operators import graph

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.range(1, 9).selectExpr("id AS src", "id + 1 AS dst").mapInArrow(count, "src long, dst long")
    assert graph.closure(edges, spark.createDataFrame([(1,)], "path long")).count() == 9
    assert made.value == 8


def test_benchmark_words_make_no_row_for_each_pattern(spark, tmp_path):
    import duckdb

    from codeweir import table_queries

    spark.createDataFrame([(1, "a bc é bc"), (2, None)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "xbcé"), (2, None), (3, "zz"), (4, "a é bc")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = table_queries.benchmark_words_in_documents(spark, str(tmp_path))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(tuple(r) for r in found.collect()) == sorted(con.execute(table_queries_sql("benchmark_words_in_documents")).fetchall())


def table_queries_sql(name):
    from codeweir import queries

    return queries.SQL[name]
