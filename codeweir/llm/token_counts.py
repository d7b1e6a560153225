"""Token counts as delta-maintained rollups.

Counts are additive: a batch of signed rows (+1 insert, -1 delete; a revision is both)
is summed by source, language and tokenizer version and committed once under its batch
id. Totals are the sum of the committed partial sums; nothing is recounted.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.llm.common import bounded_batches, fresh_path, table
from codeweir.llm.tokens import default_vocabulary, encoder

KEYS = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, documents long, tokens long, chars long"


def counted(docs: DataFrame, tokenizer: str = "byte_bpe_50k", vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """source, lang, tokenizer, n_tokens, n_chars for each row, over whole texts (null:
    empty), however long. The source and lang may be null: a group of its own. Rows that
    repeat count each; an empty table gives an empty result. Other columns are ignored."""
    path = vocabulary or default_vocabulary()
    bounded_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = [x or "" for x in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("source").cast(pa.string()), b.column("lang").cast(pa.string()), pa.array([len(enc.encode(t)) // 2 for t in texts], pa.int64()), pa.array(map(len, texts), pa.int64())],
                names=["source", "lang", "n_tokens", "n_chars"],
            )

    rows = docs.select("source", "lang", F.col(text_col).alias("__text")).mapInArrow(run, "source string, lang string, n_tokens long, n_chars long")
    return rows.withColumn("tokenizer", F.lit(tokenizer))


class CountRollup:
    """Committed batches under root, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        path, fs = self._path(f"batch-{batch}/_SUCCESS")
        return fs.exists(path)

    def commit(self, batch: str, rows: DataFrame, sign: int | None = None) -> bool:
        """Add a batch once: False, and no change, if the id was committed before. rows has
        the columns of counted(), and sign (+1 or -1) unless it is given here. A batch
        that failed midway has no success marker and is written anew."""
        if self.committed(batch):
            return False
        by = F.col("sign").cast("long") if sign is None else F.lit(sign).cast("long")
        sums = rows.groupBy(*KEYS).agg(F.sum(by).alias("documents"), F.sum(by * F.col("n_tokens")).alias("tokens"), F.sum(by * F.col("n_chars")).alias("chars"))
        sums.write.mode("overwrite").parquet(f"{self.root}/batch-{batch}")
        return True

    def batches(self) -> list[str]:
        path, fs = self._path("")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n.removeprefix("batch-") for n in names if n.startswith("batch-") and self.committed(n.removeprefix("batch-")))

    def totals(self) -> DataFrame:
        """Groups whose documents, tokens and chars all came back to zero are gone."""
        done = [f"{self.root}/batch-{b}" for b in self.batches()]
        rows = self.spark.read.schema(SUMS).parquet(*done) if done else self.spark.createDataFrame([], SUMS)
        sums = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("documents", "tokens", "chars")))
        return sums.where("documents <> 0 or tokens <> 0 or chars <> 0")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after inserting all documents."""
    rollup = CountRollup(spark, fresh_path(spark, "token-counts"))
    rows = counted(table(spark, sf_dir, "documents"))
    rollup.commit("documents", rows, sign=1)
    rollup.commit("documents", rows, sign=1)  # a repeated delivery changes nothing
    return rollup.totals()
