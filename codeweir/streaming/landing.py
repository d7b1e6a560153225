"""Tool outputs as a stream: files that land in a folder are parsed, normalised and flagged
against a baseline as they come. All of that is stateless; the merge of findings across
files is done per micro-batch and is final when a sink keeps rows by fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeweir.operators import findings as fx
from codeweir.sources import tools


def landed(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """raw_outputs from JSON-lines files as they land."""
    return spark.readStream.schema(tools.RAW).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def normalised(stream: DataFrame, baseline: DataFrame | None = None, rules: tools.ToolRules = tools.ToolRules()) -> DataFrame:
    """Findings of a raw stream, with is_new against a static baseline."""
    rows = tools.parsed(stream, rules)
    return rows if baseline is None else fx.flagged(rows, baseline)


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, baseline: DataFrame | None = None, rules: tools.ToolRules = tools.ToolRules()) -> StreamingQuery:
    """Parse, merge and append each micro-batch under out/batch=<id>. A batch that is run again
    after a failure overwrites its own folder, so every batch counts once."""

    def write(batch: DataFrame, number: int) -> None:
        found = fx.merged(tools.parsed(batch, rules))
        if baseline is not None:
            found = fx.flagged(found, baseline)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    # One micro-batch reads its files once for all parsers.
    def cached(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            write(batch, number)
        finally:
            batch.unpersist()

    return landed(spark, folder).writeStream.foreachBatch(cached).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_by_window(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of findings by category in windows of event time; rows later than the
    watermark are dropped. stream has ts and category."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "category").agg(F.count(F.lit(1)).alias("n"))
