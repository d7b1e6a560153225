"""Chat formatting by schema fingerprints.

A record is a JSON object of any known layout. The set of its nested field paths is
hashed; the fingerprint selects a declarative mapping (which paths hold the turns,
the role, the text, and what roles are called), and the record becomes canonical
turns. A template with reversible escapes then gives one string and its loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.llm.common import bounded_batches, table


#: Characters that stand for nesting in paths.
_IN_KEYS = str.maketrans({"\\": "\\\\", ".": "\\.", "[": "\\["})


def field_paths(value, at: str = "") -> set[tuple[str, str]]:
    """Nested field paths of a JSON value, with the kind of what stands there (text, number, bool,
    null; object or array if empty); array levels are written []."""
    if isinstance(value, dict):
        found = set().union(*(field_paths(v, ".".join(filter(None, (at, k.translate(_IN_KEYS) or "\\")))) for k, v in value.items()))
        return found or ({(at, "object")} if at else set())
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value)) or {(at + "[]", "array")}
    kind = "null" if value is None else "bool" if isinstance(value, bool) else "text" if isinstance(value, str) else "number"
    return {(at, kind)} if at else set()


def fingerprint(paths: Iterable[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(sorted(f"{kind} {path}" for path, kind in paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def whole(text: str | None) -> str:
    """Text with halves of surrogate pairs, which JSON allows and UTF-8 doesn't, replaced; null is empty."""
    return (text or "").encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def not_a_number(name: str):
    raise ValueError(f"{name} is no JSON")


@dataclass(frozen=True)
class Mapping:
    """turns: field of an array of turns, whose role and text fields follow and whose
    order, if given, sorts them. pairs: (role, field) of single fields, instead."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    pairs: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> dict[str, str]:
        """Its fields and their kinds."""
        if not self.turns:
            return {f: "text" for _, f in self.pairs}
        kinds = {self.role: "text", self.text: "text"} | ({self.order: "number"} if self.order else {})
        return {f"{self.turns}[].{x}": kind for x, kind in kinds.items()}

    def fingerprints(self) -> list[str]:
        """Of all layouts that this mapping reads: its fields with and without each
        optional one, and an empty array of turns."""
        full = self.paths()
        if self.turns:
            return [fingerprint(full.items()), fingerprint({(f"{self.turns}[]", "array")})]
        some = [{f for i, f in enumerate(self.optional) if bits >> i & 1} for bits in range(1 << len(self.optional))]
        return [fingerprint((f, kind) for f, kind in full.items() if f in given or f not in self.optional) for given in some]

    def read(self, record: dict) -> list[tuple[str, str]]:
        """The turns of a record of one of these layouts."""
        names = dict(self.roles)
        if self.pairs:
            return [(role, whole(record.get(f))) for role, f in self.pairs if f not in self.optional or record.get(f)]
        turns = record[self.turns]
        if self.order:
            turns = sorted(turns, key=lambda t: (t.get(self.order) is not None, t.get(self.order) or 0, t.get(self.role) or "", t.get(self.text) or ""))
        return [(names.get(t.get(self.role), whole(t.get(self.role))), whole(t.get(self.text))) for t in turns]


MAPPINGS = (
    Mapping("rows", "rows", "role", "text", "turn"),
    Mapping("messages", "messages", "role", "content"),
    Mapping("shares", "conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("instruction", pairs=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("prompt", pairs=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question", pairs=(("user", "question"), ("assistant", "answer"))),
)


@dataclass(frozen=True)
class Template:
    """<s>[ROLE]role[TEXT]text</s> for each turn. Control strings inside roles and texts
    get a backslash after their first character; backslashes are doubled."""

    begin: str = "<s>[ROLE]"
    middle: str = "[TEXT]"
    end: str = "</s>"
    control: tuple[str, ...] = ("<s>", "</s>", "[ROLE]", "[TEXT]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    _turn: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "_turn", re.compile(f"{re.escape(self.begin)}(.*?){re.escape(self.middle)}(.*?){re.escape(self.end)}", re.DOTALL))

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for c in self.control:
            text = text.replace(c, f"{c[0]}\\{c[1:]}")
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def format(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted string, and the spans (code points, end exclusive) of the
        texts that count for the loss."""
        out, at, mask = [], 0, []
        for role, text in turns:
            head, body = f"{self.begin}{self.escape(role)}{self.middle}", self.escape(text)
            if role in self.loss_roles:
                mask.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, self.end]
            at += len(head) + len(body) + len(self.end)
        return "".join(out), mask

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        return [(self.unescape(r), self.unescape(t)) for r, t in self._turn.findall(formatted)]


class Layouts:
    """Which mapping reads a record, by its fingerprint."""

    def __init__(self, mappings: tuple[Mapping, ...]):
        self.known = {f: m for m in mappings for f in m.fingerprints()}
        self.kinds = {p: kind for m in mappings for p, kind in m.paths().items()}
        self.above = {m.turns for m in mappings if m.turns} | {f"{m.turns}[]" for m in mappings if m.turns}

    def counts(self, path: str) -> bool:
        """Whether a mapping names the path, what it lies in or what lies in it."""
        return path in self.kinds or path in self.above or any(path.startswith((f"{p}.", f"{p}[]")) for p in self.kinds)

    def of(self, record) -> Mapping | None:
        """Where the whole layout isn't known, fields count that a mapping names. A null stands for
        text or a number where a mapping has one."""
        if not isinstance(record, dict):
            return None
        paths = {(p, self.kinds.get(p, kind) if kind == "null" else kind) for p, kind in field_paths(record)}
        return self.known.get(fingerprint(paths)) or self.known.get(fingerprint(x for x in paths if self.counts(x[0])))

    def turns(self, raw: str | None) -> tuple[str | None, list[tuple[str, str]] | None]:
        """The name of a record's layout and its turns, or nulls."""
        try:
            record = json.loads(raw, parse_constant=not_a_number) if raw is not None else None
            found = self.of(record)
        except (ValueError, RecursionError):
            return None, None
        return (found.name, found.read(record)) if found else (None, None)


FORMATTED = "layout string, formatted string, loss_spans array<struct<start:long,end:long>>"


def format_records(records: DataFrame, json_col: str, keep: list[str], template: Template = Template(), mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """keep columns, then layout, formatted and loss_spans of each record.

    A record that is null, no JSON object, nested deeper than the parser goes, or of an
    unknown layout has a null layout and formatted; so has one in which a field that a
    mapping names holds something else than it says (a number for a text, an object for
    a turn's text, a text or an empty object for a turn). A null text or role is empty.
    Turns of an ordered layout are sorted by
    the order field (null first), then role, then text. Fields that no mapping names (a
    turn's weight, an id) don't count where the whole layout isn't known. Half of a surrogate
    pair becomes U+FFFD. Repeated records are formatted each, whole texts however long. An empty table gives an empty result.
    keep can't name a column of the output.
    """
    if clash := {"layout", "formatted", "loss_spans"} & set(keep):
        raise ValueError(f"columns of the output can't be kept: {', '.join(sorted(clash))}")
    bounded_batches(records.sparkSession)
    layouts = Layouts(mappings)
    out_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            names, texts, masks = [], [], []
            for raw in b.column("__record").to_pylist():
                name, turns = layouts.turns(raw)
                text, mask = template.format(turns) if turns is not None else (None, None)
                names.append(name)
                texts.append(text)
                masks.append(mask and [{"start": s, "end": e} for s, e in mask] if mask is not None else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(masks, out_type)], names=[*keep, "layout", "formatted", "loss_spans"])

    rows = records.select(*keep, F.col(json_col).alias("__record"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{kept}, {FORMATTED}")


def row_records(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows of one turn each as one JSON record a conversation, of the rows layout."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.select(id_col, turn.alias("t")).groupBy(id_col).agg(F.to_json(F.struct(F.collect_list("t").alias("rows")), {"ignoreNullFields": "false"}).alias("record"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    formatted = format_records(row_records(turns.union(probe)), "record", ["conv_id"])
    return formatted.mapInArrow(read_back(Template()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string")


def read_back(template: Template):
    """The digests of op3, from the formatted strings and their spans alone."""

    def run(batches):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist()):
                turns = template.parse(text or "")
                loss = "".join(template.unescape(text[s["start"] : s["end"]]) for s in spans or [])
                for c, x in zip(cols, (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text or ""))):
                    c.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds)), b.column("layout")], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "layout"])

    return run
