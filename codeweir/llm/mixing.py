"""Mixing sources to target weights by hierarchical budgets.

A budget of tokens flows down a domain, language, source tree. Each node splits its
budget among its children by weight; a child that can't use its share (its tokens times
the epochs allowed) leaves the rest to its siblings, and only what all of them can't
use goes back up. Each leaf then takes the first tokens of its seeded epochs: whole
passes in full, and a prefix of the last one's order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeweir.llm.common import SPACE, bounded_batches, checked_broadcast, table, written
from codeweir.llm.tokens import default_vocabulary, encoder

LEVELS = ("domain", "lang", "source")
MISSING = "(none)"


@dataclass(frozen=True)
class Mix:
    """Weights by name at each level; names not listed have the default weight. share:
    of all tokens times epochs, the part to select."""

    domain_of: dict[str, str] = field(default_factory=lambda: {f"src{i}": ("web", "books", "code")[(i >= 10) + (i >= 15)] for i in range(20)})
    weights: dict[str, dict[str, float]] = field(default_factory=lambda: {"domain": {"web": 5.0, "books": 3.0, "code": 2.0}, "lang": {"en": 4.0, "fr": 2.0, "de": 2.0, "es": 2.0}, "source": {}})
    default: float = 1.0
    share: float = 0.8
    epochs: int = 1
    seed: int = 17
    #: Leading bits of the order's hash: slices whose token sums are added up before any row is.
    slice_bits: int = 10


def looked_up(col: Column, values: dict[str, object], other) -> Column:
    if not values:
        return F.lit(other)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[col], F.lit(other))


def keyed(docs: DataFrame, mix: Mix, tokens: Column, *more: str) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    return docs.select("doc_id", looked_up(name("source"), mix.domain_of, "other").alias("domain"), name("lang").alias("lang"), name("source").alias("source"), tokens.cast("long").alias("tokens"), *more)


def split_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, lang, source, tokens) with a whole number of budget tokens each.

    At each level the level w of the water is found by a running sum over siblings in the
    order of capacity over weight: children below it take all they have, the others
    w times their weight. Leaves of weight 0 get nothing. Budgets are rounded down.
    """
    weight = lambda level: looked_up(F.col(level), mix.weights.get(level, {}), mix.default).cast("double")
    nodes = leaves.withColumn("source_cap", (F.col("tokens") * mix.epochs).cast("double"))
    nodes = nodes.withColumns({f"{x}_w": weight(x) for x in LEVELS})
    nodes = nodes.withColumn("lang_cap", F.sum(F.when(F.col("source_w") > 0, F.col("source_cap")).otherwise(0)).over(Window.partitionBy("domain", "lang")))
    nodes = nodes.withColumn("source_cap", F.when(F.col("source_w") > 0, F.col("source_cap")).otherwise(0.0))
    nodes = nodes.withColumn("lang_cap", F.when(F.col("lang_w") > 0, F.col("lang_cap")).otherwise(0.0))
    langs = nodes.groupBy("domain", "lang").agg(F.first("domain_w").alias("domain_w"), F.first("lang_w").alias("lang_w"), F.first("lang_cap").alias("lang_cap"))
    domains = langs.groupBy("domain").agg(F.first("domain_w").alias("domain_w"), F.sum("lang_cap").alias("domain_cap"))
    domains = domains.withColumn("domain_cap", F.when(F.col("domain_w") > 0, F.col("domain_cap")).otherwise(0.0))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    domains = _poured(domains.withColumn("root_budget", F.lit(float(total * mix.epochs * mix.share))), [], "root_budget", "domain")
    langs = _poured(langs.join(domains.select("domain", "domain_budget"), "domain"), ["domain"], "domain_budget", "lang")
    nodes = _poured(nodes.join(langs.select("domain", "lang", "lang_budget"), ["domain", "lang"]), ["domain", "lang"], "lang_budget", "source")
    return nodes.select(*LEVELS, "tokens", F.floor("source_budget").cast("long").alias("budget"))


def _poured(nodes: DataFrame, parent: list[str], budget: str, level: str) -> DataFrame:
    cap, w = F.col(f"{level}_cap"), F.col(f"{level}_w")
    by = Window.partitionBy(*parent).orderBy(F.when(w > 0, cap / w).otherwise(0.0), level)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumns({"__full": F.coalesce(F.sum(cap).over(before), F.lit(0.0)), "__w": F.sum(w).over(rest)})
    # A child is below the water if all before it and it and the rest at its level fit.
    level_at = F.when(F.col("__w") > 0, (F.col(budget) - F.col("__full")) / F.col("__w")).otherwise(0.0)
    nodes = nodes.withColumn("__level", F.greatest(level_at, F.lit(0.0)))
    highest = F.max("__level").over(Window.partitionBy(*parent))
    return nodes.withColumn(f"{level}_budget", F.least(cap, w * highest)).drop("__full", "__w", "__level")


def order_of(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch: the first 60 bits of a hash of seed, epoch and id."""
    said = F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def placed_mix(docs: DataFrame, mix: Mix, tokens: Column) -> DataFrame:
    """One row for each document and epoch taken: doc_id, domain, lang, source, epoch (from
    0), tokens, start (tokens of the epoch before it), taken, budget (of the leaf).

    In an epoch a leaf's documents are ordered by a hash of seed, epoch and doc_id, then
    doc_id; those that begin before the budget's end are taken, the last of them in part.
    docs has the columns doc_id, lang and source; others but the text are ignored.
    Null sources and languages are a name of their own; null doc_ids come first in ties;
    documents without tokens are taken if they begin before the end. An empty table
    gives an empty result. The order's slices are summed before rows are, so that a leaf
    of any size is dealt over many tasks.
    """
    rows = written(keyed(docs, mix, tokens), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    budgets = written(split_budgets(leaves, mix).where("budget > 0"), "mix-budgets")
    named = budgets.select(*(F.col(c).alias(f"__{c}") for c in LEVELS), F.col("tokens").alias("__all"), "budget")
    same = F.lit(True)
    for c in LEVELS:
        same = same & (F.col(c) == F.col(f"__{c}"))
    leaf = [f"__{c}" for c in LEVELS]
    owned = rows.join(checked_broadcast(named, 200_000), same)
    whole = F.floor(F.col("budget") / F.col("__all")).cast("int")
    last = F.when(F.col("budget") % F.col("__all") > 0, whole + 1).otherwise(whole)
    owned = owned.withColumn("epoch", F.explode(F.sequence(F.lit(0), last - 1)))
    owned = owned.withColumn("__order", order_of(mix, F.col("epoch"), F.col("doc_id")))
    owned = owned.withColumns({"__slice": F.shiftright("__order", 60 - mix.slice_bits).cast("int"), "__left": F.col("budget") - F.col("epoch") * F.col("__all")})
    sums = owned.groupBy(*leaf, "epoch", "__slice").agg(F.sum("tokens").alias("__sum"))
    running = Window.partitionBy(*leaf, "epoch").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(running), F.lit(0))).select(*(F.col(c).alias(f"{c}_s") for c in leaf), F.col("epoch").alias("__e"), F.col("__slice").alias("__s"), "__base")
    at = (F.col("epoch") == F.col("__e")) & (F.col("__slice") == F.col("__s"))
    for c in leaf:
        at = at & (F.col(c) == F.col(f"{c}_s"))
    placed = owned.join(starts, at)
    inside = Window.partitionBy(*leaf, "epoch", "__slice").orderBy("__order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("__base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    taken = F.least(F.col("tokens"), F.col("__left") - F.col("start"))
    return placed.where(F.col("start") < F.col("__left")).select("doc_id", *LEVELS, "epoch", "tokens", "start", taken.alias("taken"), "budget", "__order")


def words(text_col: str = "text") -> Column:
    """Words of a text: what white space leaves, the measure of tokens here."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def select_mix(docs: DataFrame, mix: Mix, tokens: Column) -> DataFrame:
    """The rows of placed_mix() without the order's hash."""
    return placed_mix(docs, mix, tokens).drop("__order")


def mixed(docs: DataFrame, mix: Mix = Mix(), text_col: str = "text") -> DataFrame:
    """docs, with their columns, that the mix takes in any epoch: whole ones, so that a leaf may
    pass its budget by less than its last document. Of rows that repeat an id, a leaf takes
    all or none. What a leaf takes in an epoch is all up to a place in its order, so texts
    are filtered where they are, beside one row a leaf and epoch."""
    taken = placed_mix(docs, mix, words(text_col)).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    last = taken.groupBy(*(F.col(c).alias(f"__cut_{c}") for c in LEVELS), F.col("epoch").alias("__cut_epoch")).agg(F.max(F.struct("__order", "__id")).alias("__cut"))
    last = written(last.groupBy(*(f"__cut_{c}" for c in LEVELS)).agg(F.collect_list(F.struct("__cut_epoch", "__cut")).alias("__cuts")), "mix-cuts")
    here = keyed(docs.withColumn("__whole", F.struct(*(F.col(f"`{c}`") for c in docs.columns))), mix, F.lit(0), "__whole")
    same = F.lit(True)
    for c in LEVELS:
        same = same & (F.col(c) == F.col(f"__cut_{c}"))
    here = here.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    inside = F.exists("__cuts", lambda e: F.struct(order_of(mix, e["__cut_epoch"], F.col("doc_id")).alias("__order"), F.col("__id")) <= e["__cut"])
    return here.join(checked_broadcast(last, 200_000), same).where(inside).select("__whole.*")


def sized(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """doc_id, lang, source and n_tokens (byte-level BPE ids of the whole text; null: empty, none)."""
    path = vocabulary or default_vocabulary()
    bounded_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode(t)) // 2 if t else 0 for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(n, pa.int64())], names=["doc_id", "lang", "source", "n_tokens"])

    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, source string, n_tokens long")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets and prefixes in tokens."""
    return select_mix(sized(table(spark, sf_dir, "documents")), Mix(epochs=2, share=0.6), F.col("n_tokens"))


def mix_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mix in words, which SQL can count too."""
    return select_mix(table(spark, sf_dir, "documents"), Mix(epochs=2, share=0.6), words())


def _poured_sql(name: str, nodes: str, parents: str, budget: str, level: str) -> str:
    """A level's budgets: the water's level from running sums over siblings, fullest last."""
    by = f"PARTITION BY {parents} ORDER BY cap / w, {level}" if parents else f"ORDER BY cap / w, {level}"
    whole = f"PARTITION BY {parents}" if parents else ""
    return f"""{name}_water AS (SELECT *, greatest(({budget} - coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS water FROM {nodes}),
{name} AS (SELECT *, least(cap, w * max(water) OVER ({whole})) AS {level}_budget FROM {name}_water)"""


def mix_sql(measure: str) -> str:
    """The mix of op5_mixing, with the tokens of a row of documents as given."""
    return rf"""
WITH rows_in AS (
  SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' WHEN regexp_matches(source, '^src1[0-4]$') THEN 'books'
              WHEN regexp_matches(source, '^src1[5-9]$') THEN 'code' ELSE 'other' END AS domain,
         {measure} AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM rows_in GROUP BY ALL),
lang_nodes AS (SELECT domain, lang, CAST(sum(tokens * 2) AS DOUBLE) AS cap, CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'fr' THEN 2.0 WHEN 'de' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END AS w FROM leaves GROUP BY ALL),
domain_nodes AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'web' THEN 5.0::DOUBLE WHEN 'books' THEN 3.0 WHEN 'code' THEN 2.0 ELSE 1.0 END AS w,
                 (SELECT CAST(sum(tokens) * 2 AS DOUBLE) * 0.6::DOUBLE FROM leaves) AS root_budget FROM lang_nodes GROUP BY domain),
{_poured_sql("domains", "domain_nodes", "", "root_budget", "domain")},
lang_of AS (SELECT n.*, d.domain_budget FROM lang_nodes n JOIN domains d USING (domain)),
{_poured_sql("langs", "lang_of", "domain", "domain_budget", "lang")},
source_of AS (SELECT l.domain, l.lang, l.source, l.tokens, CAST(l.tokens * 2 AS DOUBLE) AS cap, 1.0::DOUBLE AS w, g.lang_budget FROM leaves l JOIN langs g USING (domain, lang)),
{_poured_sql("sources", "source_of", "domain, lang", "lang_budget", "source")},
given AS (SELECT domain, lang, source, tokens AS every, CAST(floor(source_budget) AS BIGINT) AS budget FROM sources WHERE floor(source_budget) > 0),
epochs AS (SELECT *, unnest(range(CAST(budget // every + CASE WHEN budget % every > 0 THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM given),
ordered AS (SELECT r.*, e.epoch, e.budget, e.budget - e.epoch * e.every AS remaining,
            CAST('0x' || substr(sha256('17:' || e.epoch || ':' || coalesce(CAST(r.doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
            FROM rows_in r JOIN epochs e USING (domain, lang, source)),
started AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ordered)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, tokens, start, least(tokens, remaining - start) AS taken, budget
FROM started WHERE start < remaining
"""


#: Of mix_by_words.
SQL = mix_sql(r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)")

__all__ = ["Mix", "mixed", "mix_by_words", "mix_sql", "op5_mixing", "select_mix", "sized", "split_budgets", "words", "SPACE"]
