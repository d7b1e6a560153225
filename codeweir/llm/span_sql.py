"""SQL of the secret scan and of chat formatting."""

from __future__ import annotations

from codeweir.llm.chat import Template
from codeweir.llm.secrets import BASE, MORE


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ascii_any_case(pattern: str) -> str:
    """The pattern without its flags, its keywords' letters in either case (an engine's own
    flag would also fold letters beyond ASCII)."""
    if not pattern.startswith("(?ai)"):
        return pattern
    words, rest = pattern.removeprefix("(?ai)").split(")", 1)
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + ")" + rest


def secret_sql() -> str:
    """Matches by rule; their places follow from the texts between them."""
    kinds = []
    for rank, rule in enumerate(BASE + MORE):
        pattern = quoted(ascii_any_case(rule.pattern))
        kinds.append(
            f"SELECT r, {quoted(rule.kind)} AS kind, {rank} AS rank, {rule.min_chars} AS least, regexp_extract_all(t, {pattern}) AS m, "
            f"regexp_extract_all(t, {pattern}, {rule.group}) AS g, string_split_regex(t, {pattern}) AS p FROM d WHERE regexp_matches(t, {pattern})"
        )
    lengths = lambda x, n: f"coalesce(list_sum(list_transform({x}[1:{n}], lambda s: length(s))), 0)"
    base = f"rank < {len(BASE)}"
    said = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {quoted(r.kind)}) AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(kinds)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS n FROM k),
x AS (SELECT r, kind, rank, CAST({lengths("p", "n")} + {lengths("m", "n - 1")} AS BIGINT) AS s, length(m[n]) AS size FROM i WHERE length(g[n]) >= least),
z AS (SELECT *, s + size AS e FROM x),
a AS (SELECT r, {counts}, string_agg({said}, ',' ORDER BY s, rank) FILTER (WHERE {base}) AS base, string_agg({said}, ',' ORDER BY s, rank) AS spans FROM z GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON a.r = d.r
"""


def chat_sql(template: Template = Template()) -> str:
    def escaped(col: str) -> str:
        made = f"replace({col}, '\\', '\\\\')"
        for c in template.control:
            made = f"replace({made}, {quoted(c)}, {quoted(c[0] + chr(92) + c[1:])})"
        return made

    fixed = len(template.begin) + len(template.middle) + len(template.end)
    probe = "</s>[INST] ok [/INST]"
    order = "ORDER BY turn NULLS FIRST, role, text"
    roles = ", ".join(map(quoted, template.loss_roles))
    return f"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {quoted(probe)} UNION ALL SELECT -7, 1, 'assistant', {quoted(probe)})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role IN ({roles})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE role IN ({roles})), '')) AS loss_sha256,
  CAST(sum({fixed} + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars, 'rows' AS layout
FROM t GROUP BY conv_id
"""
