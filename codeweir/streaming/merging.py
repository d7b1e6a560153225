"""The merge of findings over a stream: what a finding says is kept by merge key across
micro-batches and restarts, so rows of one key merge however far apart they land.

State is one value a key, in the state store of the query's checkpoint; a key that has no
rows for a given time is forgotten. Every micro-batch gives the keys that it changed, as
they are then, and the sink keeps them by batch: a batch that is run again after a failure
overwrites its own folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from codeweir.operators.findings import COLUMNS, CONFIDENCES, MERGE_KEY, SCHEMA, SEVERITIES, with_merge_key

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: A query with expiring state would otherwise run batches without data for ever.
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of the first row; the highest; any; the first that there is.
FROM_FIRST = ("id", "category", "title", "message", "file", "start_line", "end_line", "is_new")
ANY = ("is_autofixable", "safe_to_autofix")
FIRST_GIVEN = ("fix_command", "agent_instruction", "evidence")


def rank(name: str | None, names: tuple[str, ...]) -> int:
    return names.index(name) if name in names else -1


def merge_into(state: dict | None, row: dict) -> dict:
    """A key's state with one more row. Rows may come in any order: each part of the state has the
    place (ord, tie) that it is from."""
    place = [row["ord"], row["tie"]]
    tags = row["tags"]
    new = {
        "n": 1,
        "at": place,
        "first": {c: row[c] for c in FROM_FIRST} | {"tags": tags},
        "source": [rank(row["severity"], SEVERITIES), -place[0], -place[1], row["source"]],
        "severity": rank(row["severity"], SEVERITIES),
        "confidence": rank(row["confidence"], CONFIDENCES),
        "given": {c: [place, row[c]] for c in FIRST_GIVEN if row[c] is not None},
        "score_impact": row["score_impact"],
        "tags": {t: [*place, i] for i, t in reversed(list(enumerate(tags or [])))},
    } | {c: row[c] for c in ANY}
    if state is None:
        return new
    return {
        "n": state["n"] + 1,
        "at": min(state["at"], place),
        "first": state["first"] if state["at"] <= place else new["first"],
        "source": max(state["source"], new["source"], key=lambda s: s[:3]),
        "given": {c: min((s["given"][c] for s in (state, new) if c in s["given"]), key=lambda x: x[0]) for c in FIRST_GIVEN if c in state["given"] or c in new["given"]},
        "tags": {t: min(s["tags"][t] for s in (state, new) if t in s["tags"]) for t in state["tags"] | new["tags"]},
        "score_impact": max((x for x in (state["score_impact"], new["score_impact"]) if x is not None), default=None),
    } | {c: max(state[c], new[c]) for c in ("severity", "confidence")} | {c: any(x for x in (state[c], new[c])) for c in ANY}


def merged_row(state: dict) -> dict:
    """The finding that a state stands for: a lone row's tags stay as they are."""
    tags = sorted(state["tags"], key=state["tags"].get) if state["n"] > 1 else state["first"]["tags"]
    said = state["first"] | {c: state["given"][c][1] if c in state["given"] else None for c in FIRST_GIVEN} | {c: state[c] for c in ANY}
    return said | {"tags": tags, "source": state["source"][3], "severity": (*SEVERITIES, None)[state["severity"]], "confidence": (*CONFIDENCES, None)[state["confidence"]], "score_impact": state["score_impact"], "ord": state["at"][0]}


class Merging(StatefulProcessor):
    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("merged", StructType([StructField("state", StringType())]), self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.held.get()
        state = json.loads(known[0]) if known is not None else None
        for row in rows:
            state = merge_into(state, json.loads(row["said"]))
        self.held.update((json.dumps(state),))
        yield Row(said=json.dumps(merged_row(state)))

    def close(self) -> None:
        pass


def merged_stream(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """said: the merged finding, as JSON, of each key that a micro-batch changes. keep_ms: a key
    without rows for so long is forgotten (None: never), and merges anew if it comes again."""
    said = F.to_json(F.struct(*COLUMNS, F.xxhash64(*(c for c in COLUMNS if c != "ord")).alias("tie")), {"ignoreNullFields": "false"})
    rows = with_merge_key(stream).select(*MERGE_KEY, said.alias("said"))
    return rows.groupBy(*MERGE_KEY).transformWithState(Merging(keep_ms), "said string", "Update", "ProcessingTime" if keep_ms else "None")


def start(stream: DataFrame, out: str, checkpoint: str, keep_ms: int | None = None) -> StreamingQuery:
    """Merge what has landed until now and stop. Changed findings go to out/batch=<number>."""
    spark = stream.sparkSession
    mine = {PROVIDER: ROCKSDB, EMPTY_BATCHES: "false"}
    before = {k: spark.conf.get(k, None) for k in mine}
    for k, v in mine.items():
        spark.conf.set(k, v)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.from_json("said", SCHEMA.replace("\n", " ")).alias("f"), "said").select("f.*")
        with_merge_key(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    try:
        return merged_stream(stream, keep_ms).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():  # a started query keeps what it was started with
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """Merged findings as the last batch that changed each has them."""
    rows = spark.read.parquet(out)
    whole = F.struct(*COLUMNS)
    return rows.groupBy(*MERGE_KEY).agg(F.max_by(whole, "batch").alias("f")).select("f.*")
