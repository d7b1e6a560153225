"""Many literal patterns at once: an Aho-Corasick automaton as a table in arrays, run over
Arrow batches.

A batch's texts are cut into lanes that overlap by the longest pattern, and all lanes take
one byte at a time together: a step is one look-up in the table for every lane. The
table's size is known before it is sent; patterns that wouldn't fit are dealt into
several automata, each run over the same batch.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of one automaton's table; a longer pattern than its states has one of its own.
TABLE_BYTES = 32 << 20
#: Lanes that step together, and bytes of text that are looked at a time.
LANES, RUN_BYTES = 4096, 4 << 20
#: Stands between texts: no byte of UTF-8.
BETWEEN = 255


class Automaton:
    """step[state, class of a byte] is the next state; patterns that end in a state are
    ids[first[state] : first[state + 1]]."""

    def __init__(self, patterns: list[tuple[int, bytes]]):
        used = sorted(set().union(*(p for _, p in patterns)))
        self.kind = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)  # 0: bytes of no pattern
        self.kind[used] = np.arange(1, len(used) + 1)
        self.longest = max(len(p) for _, p in patterns)
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for number, p in patterns:
            at = 0
            for b in p:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ends.append([])
                at = children[at][b]
            ends[at].append(number)
        self.step = np.zeros((len(children), len(used) + 1), np.int32)
        fail, queue = [0] * len(children), deque([0])
        while queue:  # breadth first, so that what a state falls back to is finished
            at = queue.popleft()
            if at:
                self.step[at] = self.step[fail[at]]
                ends[at] = ends[at] + ends[fail[at]]
            for b, child in children[at].items():
                fail[child] = int(self.step[at, self.kind[b]])
                self.step[at, self.kind[b]] = child
                queue.append(child)
        self.first = np.concatenate(([0], np.cumsum([len(e) for e in ends]))).astype(np.int64)
        self.ids = np.array([i for e in ends for i in e], np.int64)

    def ends(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, place of its last byte) of all that data holds, in no order."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = max(-(-n // LANES), self.longest)
        lanes, over = -(-n // own), self.longest - 1
        padded = np.full(over + lanes * own, BETWEEN, np.uint8)
        padded[over : over + n] = data
        kinds = self.kind[padded]
        begin = np.arange(lanes) * own
        state, some = np.zeros(lanes, np.int32), np.diff(self.first) > 0
        found, places = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        flat, wide = self.step.ravel(), self.step.shape[1]
        for i in range(over + own):
            state = flat[state.astype(np.int64) * wide + kinds[begin + i]]
            if i >= over:  # before, a lane reads what ends in the one before it
                hit = np.flatnonzero(some[state])
                if len(hit):
                    found.append(state[hit])
                    places.append(begin[hit] + i - over)
        states, place = np.concatenate(found), np.concatenate(places)
        count = np.diff(self.first)[states]
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return self.ids[np.repeat(self.first[states], count) + nth], np.repeat(place, count)


def automata(patterns: Iterable[str], table_bytes: int = TABLE_BYTES) -> list[Automaton]:
    """Automata over the patterns' places in their list, each with a table of bounded size. Empty
    patterns have none."""
    coded = [(i, p.encode()) for i, p in enumerate(patterns) if p]
    out, held, size, used = [], [], 1, set()
    for number, p in sorted(coded, key=lambda x: x[1]):  # alike ones together, as they share states
        if held and (size + len(p)) * (len(used | set(p)) + 1) * 4 > table_bytes:
            out.append(Automaton(held))
            held, size, used = [], 1, set()
        held.append((number, p))
        size, used = size + len(p), used | set(p)
    return [*out, Automaton(held)] if held else out


def _texts(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts (null: empty) with a byte between any two, and where each begins."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if col.buffers()[2] is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return np.insert(raw, offs[1:] - offs[0], BETWEEN), offs - offs[0] + np.arange(len(offs))


def containing(df: DataFrame, text_col: str, patterns: list[str], name: str = "found") -> DataFrame:
    """df with name: the places (in patterns) of those that the text contains, in order, each once.
    Case counts. Null and empty texts contain none; neither does an empty pattern match."""
    sent = df.sparkSession.sparkContext.broadcast(automata(patterns))
    schema, many = df.schema, max(1, len(patterns))

    def run(batches):
        for b in batches:
            got: list[np.ndarray] = []
            text = b.column(b.num_columns - 1)
            size = pc.fill_null(pc.binary_length(text.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // RUN_BYTES, prepend=0))
            for i, z in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [b.num_rows])).tolist()):
                if z <= i:
                    continue
                data, begin = _texts(text.slice(i, z - i))
                pairs = [np.zeros(0, np.int64)]  # a text and a pattern as one number
                for a in sent.value:
                    ids, place = a.ends(data)
                    pairs.append(np.unique((np.searchsorted(begin, place, "right") - 1) * many + ids))
                row, ids = np.divmod(np.sort(np.concatenate(pairs)), many)
                got += np.split(ids, np.searchsorted(row, np.arange(1, z - i)))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *got]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*b.schema.names[:-1], name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return df.select("*", F.col(text_col).alias("__text")).mapInArrow(run, f"{kinds}, `{name}` array<int>")
