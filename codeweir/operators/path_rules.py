"""Path rules of many projects: a table of globs, compiled for each project to a trie of path
segments that all its paths walk, instead of one alternation a path.

Projects of many paths are dealt over several tasks, each with the project's rules. A
directory's place in the trie is worked out once a task, whatever number of files it has.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweir.functions.text import expand_braces, glob_regex

#: Paths of a project that a task takes, on average; directories that it remembers.
PATHS, KNOWN = 50_000, 100_000
_MAGIC = re.compile(r"[*?\[]")


class Node:
    """plain: segments by name; magic: (pattern of a segment, node); deep: what follows "**"; ends:
    rules that end here; below: rules that take everything below."""

    __slots__ = ("plain", "magic", "deep", "ends", "below")

    def __init__(self):
        self.plain: dict[str, Node] = {}
        self.magic: dict[str, tuple[re.Pattern, Node]] = {}
        self.deep: Node | None = None
        self.ends: list[int] = []
        self.below: list[int] = []


class Trie:
    """Globs as functions.text.glob_regex() has them, by number."""

    def __init__(self, globs: list[tuple[int, str]]):
        self.root, self.known = Node(), {}
        for number, glob in globs:
            for one in expand_braces(glob):
                self._add(number, one.split("/"))

    def _add(self, number: int, parts: list[str]) -> None:
        at = self.root
        for i, part in enumerate(parts):
            if part == "**":
                if i == len(parts) - 1:
                    at.below.append(number)
                    if i == 0:
                        at.ends.append(number)
                    return
                at.deep = at.deep or Node()
                at = at.deep
            elif _MAGIC.search(part):
                if part not in at.magic:
                    at.magic[part] = (re.compile(glob_regex(part), re.DOTALL), Node())
                at = at.magic[part][1]
            else:
                at = at.plain.setdefault(part, Node())
        at.ends.append(number)

    def _opened(self, nodes) -> tuple[Node, ...]:
        """Nodes, and those that a "**" of no directories leads to."""
        out, todo = {}, list(nodes)
        while todo:
            n = todo.pop()
            if id(n) not in out:
                out[id(n)] = n
                if n.deep is not None:
                    todo.append(n.deep)
        return tuple(out.values())

    def _step(self, nodes: tuple[Node, ...], segment: str) -> list[Node]:
        found = []
        for n in nodes:
            if segment in n.plain:
                found.append(n.plain[segment])
            found += [child for pattern, child in n.magic.values() if pattern.match(segment)]
        return found

    def _directory(self, parts: tuple[str, ...]):
        """Where a directory's path leads: nodes; those that "**" keeps open; rules that take all below."""
        if not parts:
            nodes = self._opened([self.root])
            return nodes, frozenset(), frozenset(r for n in nodes for r in n.below)
        if parts in self.known:
            return self.known[parts]
        nodes, held, below = self._directory(parts[:-1])
        segment = parts[-1]
        # "**" stands for directories with a name: what follows it stays open below them.
        deep = {n.deep for n in nodes if n.deep is not None} | held if segment else set()
        stepped = self._opened([*self._step(nodes, segment), *deep])
        taken = (below if segment else frozenset()) | {r for n in nodes for r in n.below if segment}
        new = stepped, frozenset(deep), taken | {r for n in stepped for r in n.below}
        if len(self.known) >= KNOWN:
            self.known.clear()
        self.known[parts] = new
        return new

    def rules(self, path: str) -> list[int]:
        """Numbers of the rules that the path matches, in order."""
        parts = path.split("/")
        if path == "":
            return sorted(set(self.root.ends) | {r for n in self._step(self._opened([self.root]), "") for r in n.ends})
        nodes, _, below = self._directory(tuple(parts[:-1]))
        found = {r for n in self._step(nodes, parts[-1]) for r in n.ends}
        return sorted(found | (set(below) if parts[-1] else set()))


def ruled(paths: DataFrame, rules: DataFrame, name: str = "rules") -> DataFrame:
    """paths (project, path, others) with the numbers of the project's rules (project, rule, glob)
    that each path matches, in order. A null path, and one of a project without rules,
    matches none; rules without a project or a glob are left out. Each row stays one row. Globs
    that are plain paths meet them by a join; the trie holds the others."""
    plain = ~F.col("glob").rlike(r"[*?\[{]")
    exact = rules.where(plain).groupBy(F.col("project").alias("e_project"), F.col("glob").alias("e_path")).agg(F.collect_set(F.col("rule").cast("long")).alias("__exact"))
    sizes = paths.groupBy(F.col("project").alias("s_project")).agg(F.ceil(F.count(F.lit(1)) / PATHS).cast("int").alias("salts"))
    of_project = F.col("project").eqNullSafe(F.col("s_project"))
    dealt = paths.join(sizes, of_project).drop("s_project")
    dealt = dealt.withColumn("__salt", F.pmod(F.xxhash64("path"), F.col("salts")).cast("int")).drop("salts")
    known = rules.where("project is not null and glob is not null").where(~plain).groupBy(F.col("project").alias("r_project")).agg(F.collect_list(F.struct("rule", "glob")).alias("globs"))
    given = known.join(sizes, F.col("r_project") == F.col("s_project")).select("r_project", "globs", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("r_salt"))
    columns = paths.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = Trie([(g["rule"], g["glob"]) for g in right["globs"][0].as_py()]) if len(right) else None
        text = left["path"].combine_chunks().dictionary_encode() if len(left) else None
        if text is None:
            return left.select(columns).append_column(name, pa.array([], pa.list_(pa.int64())))
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        each = [made.rules(p) if made and p is not None else [] for p in text.dictionary.to_pylist()]
        found = [each[i] if i is not None else [] for i in text.indices.to_pylist()]
        return left.select(columns).append_column(name, pa.array(found, pa.list_(pa.int64())))

    groups = dealt.groupBy("project", "__salt").cogroup(given.groupBy("r_project", "r_salt"))
    found = groups.applyInArrow(run, f"{kinds}, `{name}` array<long>").join(exact, (F.col("project") == F.col("e_project")) & (F.col("path") == F.col("e_path")), "left")
    every = F.when(F.col("__exact").isNull(), F.col(name)).otherwise(F.sort_array(F.array_union(name, "__exact")))
    return found.select(*(f"`{c}`" for c in columns), every.alias(name))


def chosen(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths that a rule of their project includes and none excludes. rules have exclude besides."""
    out = {True: "left_out", False: "taken"}
    rows = paths
    for exclude, name in out.items():
        rows = ruled(rows, rules.where(F.col("exclude") == exclude), name)
    return rows.where((F.size("taken") > 0) & (F.size("left_out") == 0)).drop(*out.values())

