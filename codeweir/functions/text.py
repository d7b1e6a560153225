"""Column expressions whose results must equal those of ECMAScript string and number
functions: trimming, word boundaries, fixed decimals, paths and globs."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of ECMAScript's trim() and \s, for a character class.
WS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(col: Column) -> Column:
    return F.regexp_replace(col, f"^[{WS}]+|[{WS}]+$", "")


def squeeze(col: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(col, f"[{WS}]+", " "))


def word(pattern: str, start: bool = True, end: bool = True) -> str:
    """A pattern between ASCII word boundaries (Java's own are Unicode-aware)."""
    return ("(?<![A-Za-z0-9_])" if start else "") + f"(?:{pattern})" + ("(?![A-Za-z0-9_])" if end else "")


def lines(content: Column) -> Column:
    return F.split(content, "\r?\n", -1)


def text_or(col: Column, other: str) -> Column:
    """The value in a template: a missing one is written as `other`."""
    return F.coalesce(col.cast("string"), F.lit(other))


def templated(*parts) -> Column:
    """Concatenation of strings and columns, null as "undefined"."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else text_or(p, "undefined") for p in parts))


def to_fixed(x: float, digits: int = 2) -> Decimal:
    """Rounds the exact binary value, halves up."""
    return Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)


def number_text(col: Column) -> Column:
    """A double as ECMAScript prints it: whole numbers without a point."""
    return F.when(col == F.floor(col), F.floor(col).cast("string")).otherwise(col.cast("string"))


def dirname(path: Column) -> Column:
    """POSIX directory of a relative path; "." where it has none."""
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), F.when(cut == "", "/").otherwise(cut)).otherwise(".")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def normalise_path(path: Column) -> Column:
    """Folds "." and ".." segments of a relative POSIX path."""
    step = lambda done, s: (
        F.when((s == "") | (s == "."), done)
        .when((s == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s)))
    )
    safe = F.when(F.size(F.split(path, "/")) > 0, F.split(path, "/"))
    folded = F.aggregate(safe, F.array().cast("array<string>"), lambda done, s: F.when(F.size(done) == 0, F.when((s == "") | (s == "."), done).otherwise(F.array(s))).otherwise(step(done, s)))
    return F.when(F.size(folded) == 0, ".").otherwise(F.array_join(folded, "/"))


def expand_braces(glob: str) -> list[str]:
    m = re.search(r"\{([^{}]*,[^{}]*)\}", glob)
    if not m:
        return [glob]
    return [x for part in m[1].split(",") for x in expand_braces(glob[: m.start()] + part + glob[m.end() :])]


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression. ** between slashes spans any number of
    directories, * and ? stay inside one, dotfiles match."""
    made = []
    for one in expand_braces(glob):
        parts, out = one.split("/"), ""
        for i, part in enumerate(parts):
            last = i == len(parts) - 1
            if part == "**":
                out += "(?:[^/]+(?:/[^/]+)*)?" if last and i == 0 else "[^/]+(?:/[^/]+)*" if last else "(?:[^/]+/)*"
                continue
            for token in re.findall(r"\*+|\?|\[[^\]]+\]|.", part):
                if token.startswith("*"):
                    out += "[^/]*" if len(part) > len(token) else "[^/]+"
                elif token == "?":
                    out += "[^/]"
                elif token[0] == "[" and len(token) > 1:
                    out += "[" + ("^" + token[2:-1] if token[1] in "!^" else token[1:-1]) + "]"
                else:
                    out += re.escape(token)
            out += "" if last else "/"
        made.append(out)
    return "^(?:" + "|".join(made) + ")$"


def matches_globs(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Matches any include and no exclude."""
    some = lambda globs: "|".join(glob_regex(g) for g in globs)
    found = path.rlike(some(include)) if include else F.lit(False)
    return found & ~path.rlike(some(exclude)) if exclude else found
