"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. A ledger
records which (blob, rule version) pairs have been scanned; an ingest scans only the
pairs it lacks, each distinct blob once, and findings join back to all paths.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.llm.common import bounded_batches, checked_broadcast, fresh_path, table, written


@dataclass(frozen=True)
class Rule:
    """A pattern of one version. group, min_chars: the group whose length counts."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    min_chars: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base patterns come first, in this order.
BASE = (
    Rule("assign", 1, r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
MORE = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: Blobs with findings that are broadcast, at most, and their bytes.
MAX_BROADCAST, MAX_BROADCAST_BYTES = 500_000, 32 << 20
SPAN = "array<struct<kind:string,start:long,end:long>>"


def scan(text: str, rules) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost non-overlapping for each rule."""
    found = []
    for rule in rules:
        for m in re.finditer(rule.pattern, text):
            if len(m.group(rule.group)) >= rule.min_chars:
                found.append((rule.kind, m.start(), m.end()))
    return found


class BlobLedger:
    """Ledger tables under root, a folder that driver and executors share.

    Each ingest appends one batch: blob, rules (keys scanned), spans. A batch
    becomes visible when its write commits; a repeated ingest finds its pairs there
    and scans nothing. Null content counts as empty; every distinct blob, the empty
    one too, has its row. Ingests that overlap may both scan a pair; its spans count once.
    Whole contents are scanned, however long; an empty table adds and finds nothing.
    """

    def __init__(self, spark: SparkSession, root: str, rules: tuple[Rule, ...] = BASE + MORE):
        self.spark, self.root, self.rules = spark, root.rstrip("/"), rules
        self.batches: list[str] = []

    def _stored(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/scans")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        done = [str(x.getPath()) for x in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{x.getPath()}/_SUCCESS"))]
        return self.spark.read.schema(f"blob string, rules array<string>, spans {SPAN}").parquet(*done) if done else None

    def ingest(self, versions: DataFrame, content: str = "text") -> None:
        """Scan the (blob, rule version) pairs of versions that the ledger lacks."""
        keys = F.array(*(F.lit(r.key) for r in self.rules))
        bounded_batches(self.spark)
        text = F.coalesce(F.col(content), F.lit(""))
        blobs = versions.select(F.sha2(text, 256).alias("__blob"), text.alias("__content")).groupBy("__blob").agg(F.first("__content").alias("__content"))
        stored = self._stored()
        if stored is None:
            todo = blobs.withColumn("__todo", keys)
        else:
            seen = stored.groupBy(F.col("blob").alias("__seen")).agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("__done"))
            todo = blobs.join(seen, F.col("__blob") == F.col("__seen"), "left").withColumn("__todo", F.array_except(keys, F.coalesce("__done", F.array().cast("array<string>"))))
            todo = todo.where(F.size("__todo") > 0)
        rules = {r.key: r for r in self.rules}

        def scanned(batches):
            kinds = pa.schema([("blob", pa.string()), ("rules", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
            for b in batches:
                todo_keys = b.column("__todo").to_pylist()
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t.as_py(), [rules[x] for x in names])] for t, names in zip(b.column("__content"), todo_keys)]
                yield pa.RecordBatch.from_arrays([b.column("__blob").cast(pa.string()), pa.array(todo_keys, kinds.field("rules").type), pa.array(spans, kinds.field("spans").type)], schema=kinds)

        out = todo.select("__blob", "__content", "__todo").mapInArrow(scanned, f"blob string, rules array<string>, spans {SPAN}")
        out.write.parquet(f"{self.root}/scans/batch-{uuid.uuid4().hex}")

    def findings(self) -> DataFrame:
        """blob and all its spans under the current rule versions (a rule's older
        versions don't count), in the order of start, then of the rules."""
        stored = self._stored()
        order = F.create_map(*(F.lit(x) for i, r in enumerate(self.rules) for x in (r.kind, i)))
        empty = self.spark.createDataFrame([], f"blob string, rules array<string>, spans {SPAN}")
        keys = F.create_map(*(F.lit(x) for r in self.rules for x in (r.kind, r.key)))
        current = (stored if stored is not None else empty).withColumn("spans", F.filter("spans", lambda s: F.array_contains("rules", keys[s["kind"]])))
        merged = current.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
        ranked = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return merged.select("blob", ranked.alias("spans"))

    def joined(self, versions: DataFrame, content: str = "text") -> DataFrame:
        """versions without the content, with secret_spans: the spans of each row's blob, null if
        it has none. Rows that repeat, and null contents, have their blob's. versions may have
        any columns but secret_spans, which is replaced. Blobs with findings are broadcast
        while they are few; beyond that the join is an equi-join, whose large keys adaptive
        execution splits."""
        kept = [c for c in versions.columns if c not in (content, "secret_spans")]
        rows = versions.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("__blob"))
        hits = self.findings().where(F.size("spans") > 0).select(F.col("blob").alias("__hit"), F.col("spans").alias("secret_spans"))
        hits = checked_broadcast(written(hits, "secret-hits"), MAX_BROADCAST, MAX_BROADCAST_BYTES)
        return rows.join(hits, F.col("__blob") == F.col("__hit"), "left").select("__row.*", "secret_spans")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = BlobLedger(spark, fresh_path(spark, "secrets"))
    ledger.ingest(docs)
    spans = F.coalesce("secret_spans", F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>"))
    shown = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = ledger.joined(docs).withColumn("s", spans)
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("s", lambda x: x["rank"] < len(BASE))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("s")).alias("spans"))


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """op2's rows from plain scans of every text (for tests)."""
    out, order = [], {r.kind: i for i, r in enumerate(BASE + MORE)}
    for doc_id, text in rows:
        spans = sorted(scan(text or "", BASE + MORE), key=lambda s: (s[1], order[s[0]]))
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in spans if order[k] < len(BASE))
        out.append((doc_id, *(sum(k == r.kind for k, _, _ in spans) for r in BASE), hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in spans)))
    return out
