"""Leftovers: stale markers, commented-out code, legacy names, flags and fallback
branches, found line by line. One explode of lines feeds all matchers; the vocabulary
is tested inside the row, so nothing is joined or shuffled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweir.functions.text import lines, templated, trim, word
from codeweir.operators.findings import EVIDENCE, completed

# The vocabulary by group, name prefixes, and lines that don't count.
VOCABULARY = {
    "legacy": ("legacy", "backward compatibility", "backwards compatibility", "compat", "shim"),
    "temporary": ("todo", "fixme", "temporary", "temp", "for now", "remove later"),
    "fallback": ("fallback", "just in case", "old implementation", "previous implementation"),
    "deprecated": ("deprecated", "old", "unused", "dead code"),
}
NAMES = ("old", "legacy", "deprecated", "compat", "fallback", "v1", "previous")
DOCUMENTS = "^changelog\\b|^release notes?\\b|^copyright\\b|^migration\\b|^history\\b|^example\\b"
ABOUT_RULES = """patterns|rules for|this detector|agent skills|codeweir.*(legacy|fallback|dead|leftovers)|do not (delete|remove).* (low|dead|legacy|compat)|"legacy"|'legacy'|leftover.*patterns|dead.chain|refactor.*readiness"""
ABOUT_DETECTOR = "fallback-branch|name-signal|flag-signal|commented-code|find(Comment|Name|Fallback|Flag)Matches|envGuardMatch|LEFTOVER_NAME|scanLegacyFallbacks|scanCommentedCode|shouldIgnoreLine"
EXAMPLES = '"legacy"|"fallback"|"compat"|"oldflow"|"LEGACY|OLD|FALLBACK|COMPAT'
EXAMPLE_USES = "includes|hasFallbackSignal|hasControlFlow|lower\\.includes"
ABOUT_CHANGES = "this (cleans|addresses|removes)|treat as (success|ok)|normali[sz]|legacy (score|handling|path)"
DECLARATIONS = "function|class|const|let|var|export|def"
CODE_WORDS = "const|let|var|function|class|return|def|import|from"
ENV_FLAG = "[A-Z][A-Z0-9_]*(?:LEGACY|OLD|FALLBACK|COMPAT|DEPRECATED|PREVIOUS|V1)[A-Z0-9_]*"
ENV_GUARD = "[A-Z][A-Z0-9_]*(?:LEGACY|OLD|FALLBACK|COMPAT|V1)[A-Z0-9_]*"
FEATURE_FLAG = "(?:legacy|old|fallback|compat|deprecated|previous)[A-Z][A-Za-z0-9]+"
BRANCHES = "if|else|catch|except|try|switch"
SELF_FILES = "customLeftovers|leftoverPatterns|agentPack/templates"
SOURCE_FILES = r"\.(ts|tsx|js|jsx|py)$"
TITLES = {"commented-code": "Commented-out code", "fallback-branch": "Legacy fallback path appears present", "flag-signal": "Legacy flag or env toggle"}
MARKER = "Legacy or temporary marker"
FALLBACK_HINT = "Verify the fallback is still required; if not, remove it and update tests."
STALE_HINT = "Confirm the legacy note is still needed. Delete stale comments or code after verifying behavior."


@dataclass(frozen=True)
class LeftoverRules:
    comments: bool = True
    commented_code: bool = True
    fallbacks: bool = True


def about_documents(text: Column) -> Column:
    return trim(text).rlike("(?i)" + DOCUMENTS.replace("\\b", "(?![A-Za-z0-9_])"))


def ignored(text: Column) -> Column:
    """Documentation, and lines about the rules or the detector themselves."""
    t = F.lower(trim(text))
    return (
        about_documents(t)
        | t.rlike(f"(?i){ABOUT_RULES}")
        | t.rlike(f"(?i){ABOUT_DETECTOR}")
        | (t.rlike(f"(?i){EXAMPLES}") & t.rlike(f"(?i){EXAMPLE_USES}"))
        | t.rlike(f"(?i){ABOUT_CHANGES}")
    )


def match(group: str, pattern: Column, text: Column, confidence: Column | str, severity: str, hint: Column | str | None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(group).alias("group"), pattern.alias("pattern"), text.alias("text"), lit(confidence).alias("confidence"), lit(severity).alias("severity"), lit(hint).cast("string").alias("hint"))


def comment_text(path: Column, line: Column) -> Column:
    """Text of a comment line, null for others."""
    t = trim(line)
    mark = F.when(path.endswith(".py"), "#").otherwise("//")
    text = t
    for lead in ("^//", "^#", "^/\\*", "^\\*"):
        text = F.regexp_replace(text, lead, "")
    return F.when(t.startswith(mark) | t.startswith("/*") | t.startswith("*"), trim(text))


def vocabulary_matches(text: Column) -> Column:
    """A match for each (group, pattern) that the lower-cased text contains."""
    low = F.lower(text)
    every = F.array(*(F.when(low.contains(p), match(g, F.lit(p), text, "medium", "low", None)) for g, ps in VOCABULARY.items() for p in ps))
    return F.filter(every, lambda m: m.isNotNull())


def line_matches(path: Column, line: Column, rules: LeftoverRules) -> tuple[Column, Column, Column, Column]:
    """Arrays of matches of comments, names, flags and fallbacks, in that order."""
    none = F.array_except(F.array(match("", F.lit(""), line, "", "", None)), F.array(match("", F.lit(""), line, "", "", None)))
    some = lambda cond, arr: F.when(F.coalesce(cond, F.lit(False)), arr).otherwise(none)
    t, low = trim(line), F.lower(line)
    text, skip = comment_text(path, line), ignored(line)
    vocabulary = some(F.lit(rules.comments), vocabulary_matches(text))
    code = some(text.rlike(word(CODE_WORDS)) & F.lit(rules.commented_code), F.array(match("commented-code", F.lit("commented code"), text, "high", "low", None)))
    comments = some(text.isNotNull() & ~about_documents(text) & ~ignored(text), F.concat(vocabulary, code))
    named = F.filter(F.array(*(F.when(line.rlike(f"(?i)(?<![A-Za-z0-9_]){n}"), match("name-signal", F.lit(n), t, "low", "low", None)) for n in NAMES)), lambda m: m.isNotNull())
    names = some(low.rlike(word(DECLARATIONS)) & ~skip, named)
    env = F.regexp_extract(t, f"({word(ENV_FLAG)})", 1)
    feature = F.regexp_extract(t, f"({word(FEATURE_FLAG)})", 1)
    flag = F.when(env != "", env).when(feature != "", feature)
    flag_hint = F.concat(F.lit("Confirm whether "), flag, F.lit(" is still an active environment variable or feature flag. Remove dead fallback wiring if not."))
    flags = some(flag.isNotNull() & ~skip, F.array(match("flag-signal", flag, t, "medium", "low", flag_hint)))
    signal = low.contains("legacy") | low.contains("fallback") | low.contains("compat") | low.contains("oldflow")
    branch = low.rlike(word(BRANCHES)) | (low.contains("?") & low.contains(":"))
    guard = F.regexp_extract(line, f"({word(ENV_GUARD)})", 1)
    hint = F.when(guard != "", F.concat(F.lit("Verify whether "), guard, F.lit(" is still a supported flag. If not, remove the fallback and update tests."))).otherwise(FALLBACK_HINT)
    kind = F.when(low.contains("legacy"), "legacy branch").otherwise("fallback branch")
    fall = F.array(match("fallback-branch", kind, t, F.when(guard != "", "medium").otherwise("high"), "medium", hint))
    return comments, names, flags, some(signal & branch & ~skip & F.lit(rules.fallbacks), fall)


def _stepped(step: int):
    return lambda x: F.struct(F.lit(step).alias("step"), x.alias("m"))


def matched_lines(files: DataFrame, rules: LeftoverRules = LeftoverRules()) -> DataFrame:
    """path, line, step (matcher), at, and the match, for files (path, content)."""
    rows = files.where(F.col("path").rlike(SOURCE_FILES) & ~F.col("path").rlike(SELF_FILES) & (F.length("content") > 0))
    each = rows.select("path", F.posexplode(lines(F.col("content"))).alias("pos", "text"))
    parts = line_matches(F.col("path"), F.col("text"), rules)
    tagged = [F.transform(m, _stepped(i)) for i, m in enumerate(parts)]
    found = each.select("path", (F.col("pos") + 1).alias("line"), F.posexplode(F.concat(*tagged)).alias("at", "x"))
    return found.select("path", "line", F.col("x.step").alias("step"), "at", "x.m.*")


def leftovers(files: DataFrame, rules: LeftoverRules = LeftoverRules(), ordinal: Column | None = None) -> DataFrame:
    """Findings. Their ord keeps the matchers' order inside a file: by matcher, line and
    place; ordinal (a column over path) goes before that, if given."""
    rows = matched_lines(files, rules)
    group = F.col("group")
    title = F.coalesce(F.create_map(*(F.lit(x) for kv in TITLES.items() for x in kv))[group], F.lit(MARKER))
    place = F.col("step").cast("long") * F.lit(1 << 36) + F.col("line").cast("long") * 64 + F.col("at")
    return completed(
        rows.select(
            templated("leftover:", F.col("path"), ":", F.col("line"), ":", F.col("pattern")).alias("id"),
            F.lit("custom-leftovers").alias("source"),
            F.lit("leftovers").alias("category"),
            "severity",
            "confidence",
            title.alias("title"),
            F.col("text").alias("message"),
            F.col("path").alias("file"),
            F.col("line").alias("start_line"),
            F.coalesce("hint", F.when(group == "fallback-branch", FALLBACK_HINT).otherwise(STALE_HINT)).alias("agent_instruction"),
            F.array(F.lit("leftovers"), group).alias("tags"),
            F.struct(F.col("text").alias("snippet"), F.lit(None).cast("string").alias("tool_raw_id"), F.col("pattern").alias("matched_pattern")).cast(EVIDENCE).alias("evidence"),
            (place if ordinal is None else ordinal.cast("long") * F.lit(1 << 39) + place).alias("ord"),
        )
    )
