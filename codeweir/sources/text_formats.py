"""Tools that report in lines of text, as a table function: its columns are the named groups of
the pattern that it is given, known when a query is planned."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from codeweir.operators.findings import completed
from codeweir.sources import tools

NAME = "matched_lines"


class MatchedLines:
    """matched_lines(text, pattern): line_no (from 1) and the named groups, as text, of each line
    that the whole pattern matches. The pattern must be constant and have named groups. Null
    and empty texts have no lines that match."""

    @staticmethod
    def analyze(text: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(pattern.value, str):
            raise ValueError(f"{NAME} takes a constant pattern")
        names = sorted(re.compile(pattern.value).groupindex.items(), key=lambda x: x[1])
        if not names:
            raise ValueError(f"the pattern of {NAME} has no named groups")
        return AnalyzeResult(StructType([StructField("line_no", IntegerType()), *(StructField(n, StringType()) for n, _ in names)]))

    def eval(self, text: str, pattern: str):
        found = re.compile(pattern)
        for n, line in enumerate(re.split("\r?\n", text or ""), 1):
            if m := found.fullmatch(line):
                yield n, *(m[i] for i in sorted(found.groupindex.values()))


def use(spark: SparkSession) -> None:
    """Make the function known to a session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(NAME, udtf(MatchedLines))


def lines_of(df: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """df's columns beside those of matched_lines(), a row a line, by a lateral call."""
    spark = df.sparkSession
    use(spark)
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return spark.sql(f"SELECT * FROM {{df}} AS d, LATERAL {NAME}(d.`{text_col}`, '{quoted}')", df=df)


def register_lines(tool: str, pattern: str, category: str, severity: Callable = lambda: F.lit("medium"), **fixed) -> None:
    """Add a tool whose output is lines of text. The pattern's groups file, line, title and message
    fill a finding's; severity is a column made of any of them; fixed: other columns."""

    def parser(raw: DataFrame, rules: tools.ToolRules) -> DataFrame:
        mine = raw.where((F.col("source") == tool) & (F.coalesce("status", F.lit("ok")) != "skipped")).select("stdout")
        rows = lines_of(mine, "stdout", pattern)
        has = set(rows.columns)
        of = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
        made = {
            "id": F.concat_ws(":", F.lit(tool), of("file"), of("line"), of("title")), "source": F.lit(tool), "category": F.lit(category), "severity": severity(), "confidence": F.lit("high"),
            "title": of("title"), "message": of("message"), "file": tools.relative(of("file"), rules.root), "start_line": of("line").try_cast("int"), "ord": (F.col("line_no") - 1).cast("long"),
        }
        return completed(rows.select(*(c.alias(n) for n, c in (made | {k: F.lit(v) for k, v in fixed.items()}).items())))

    tools.register(tool, "string", parser)
