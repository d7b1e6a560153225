"""Baselines as versions of a bucketed table: fingerprints are dealt into buckets and sorted once,
when a version is written, so comparing with one moves findings only.

A folder holds a manifest and a table for each version. The manifest is replaced last and in
one move: a version is there as a whole or not at all, and an old one stays readable.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.operators.findings import COLUMNS, fingerprint

MANIFEST = "manifest.json"


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    buckets: int
    rows: int


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, new, at) -> None:
    """Move a file over another, in one step."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = getattr(hadoop, "Options$Rename")
    given = spark.sparkContext._gateway.new_array(over, 1)
    given[0] = over.OVERWRITE
    files = hadoop.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    files.rename(files.makeQualified(new), files.makeQualified(at), given)


def versions(spark: SparkSession, home: str) -> list[Version]:
    """What the manifest has, oldest first; none without a manifest."""
    at, fs = _path(spark, f"{home}/{MANIFEST}")
    if not fs.exists(at):
        return []
    text = spark.read.text(f"{home}/{MANIFEST}", wholetext=True).first()[0]
    return [Version(**v) for v in json.loads(text)["versions"]]


def _table(spark: SparkSession, home: str, version: Version) -> str:
    """The version as a table of this session's catalog, which knows its buckets."""
    name = f"baseline_{version.folder.replace('-', '_')}"
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} (fingerprint STRING) USING parquet CLUSTERED BY (fingerprint) SORTED BY (fingerprint) INTO {version.buckets} BUCKETS LOCATION '{home}/{version.folder}'")
    return name


def write_version(findings: DataFrame, home: str, buckets: int = 64) -> Version:
    """A new version with the distinct fingerprints of findings. buckets: as many as tasks should
    compare with it; a bucket is one file."""
    spark = findings.sparkSession
    old = versions(spark, home)
    number, folder = len(old) + 1, f"v{len(old) + 1}-{uuid.uuid4().hex}"
    name = f"baseline_{folder.replace('-', '_')}"
    prints = findings.select(fingerprint().alias("fingerprint")).distinct().repartition(buckets, "fingerprint")
    prints.write.bucketBy(buckets, "fingerprint").sortBy("fingerprint").option("path", f"{home}/{folder}").format("parquet").saveAsTable(name)
    made = Version(number, folder, buckets, spark.table(name).count())
    text = json.dumps({"versions": [asdict(v) for v in (*old, made)]}, indent=2)
    new, fs = _path(spark, f"{home}/{MANIFEST}.{folder}")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    _replace(spark, new, _path(spark, f"{home}/{MANIFEST}")[0])
    return made


def baseline(spark: SparkSession, home: str, number: int | None = None) -> tuple[DataFrame, int]:
    """Fingerprints of a version (the last, unless numbered) and its buckets; an empty one, if there
    is none."""
    known = versions(spark, home)
    if not known:
        return spark.createDataFrame([], "fingerprint string"), 1
    version = known[-1 if number is None else number - 1]
    return spark.table(_table(spark, home, version)), version.buckets


def flagged(findings: DataFrame, home: str, number: int | None = None) -> DataFrame:
    """is_new: whether the version lacks the finding. Findings are dealt into the version's buckets
    and merged with them as they lie: nothing of the baseline is shuffled or sorted."""
    known, buckets = baseline(findings.sparkSession, home, number)
    rows = findings.withColumn("__fp", fingerprint()).repartition(buckets, "__fp")
    rows = rows.join(known.select(F.col("fingerprint").alias("b_fp")).hint("merge"), F.col("__fp") == F.col("b_fp"), "left")
    own_id = F.when(F.length("id") > 0, F.col("id")).otherwise(F.col("__fp"))
    return rows.withColumns({"id": own_id, "is_new": F.col("b_fp").isNull()}).select(*COLUMNS)
