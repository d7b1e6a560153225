"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over the presence of
hashed words and word stems. A later model also gets the earlier categories'
probabilities: in training those of out-of-fold models, which haven't seen the row.
Training uses a bounded sample of labelled rows; every row is scored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweir.llm.common import bounded_batches, mix, row_slices, table, text_buffers, word_spans, written

DIM = 1 << 20
#: Prefix lengths (bytes of letters) that stand for stems.
STEMS = (3, 4, 5, 6)
#: Labelled rows to train on, at most, and the bytes of text of each that are read at most
#: in training (longer labelled rows aren't drawn). Folds of the chain.
SAMPLE, SAMPLE_BYTES, FOLDS = 8000, 16_000, 3
#: Categories in the order of the chain: name, label column, the label's positive value.
CHAIN = (("junk", "quality", 0), ("toxic", "toxic", 1))
THRESHOLD = 0.5


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers (below DIM) of each value, and their n + 1 offsets:
    words in lower case without punctuation at their ends, and their stems."""
    pairs = [np.zeros(0, np.int64)]
    clean = _LETTERS[data]
    spaced = np.where(clean == 0, np.uint8(32), clean)
    for h, s, e in word_spans(spaced, offs, lower=False):
        owner = (np.searchsorted(offs, s, "right") - 1) << 20
        found = [owner + (h >> np.uint64(44)).astype(np.int64)]
        for n in STEMS:
            longer = e - s > n
            at = s[longer]
            stem = np.full(len(at), n, np.uint64)
            for j in range(n):
                stem = stem * np.uint64(0x100000001B3) + spaced[at + j]
            found.append(owner[longer] + (mix(stem + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64))
        pairs.append(np.unique(np.concatenate(found)))  # a block at a time, so that a long text stays small
    pair = np.unique(np.concatenate(pairs))
    return pair & (DIM - 1), np.searchsorted(pair >> 20, np.arange(len(offs)))


def _letters() -> np.ndarray:
    """Bytes of words: a-z (A-Z lowered) and all of UTF-8's other letters."""
    out = np.zeros(256, np.uint8)
    out[97:123] = out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


_LETTERS = _letters()


@dataclass
class Linear:
    """Logistic regression over selected features, then dense extras, then a bias."""

    at: np.ndarray  # feature numbers
    weights: np.ndarray  # float32, of these
    extra: np.ndarray
    bias: float
    _dense: np.ndarray | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_dense": None}

    def margin(self, cols: np.ndarray, offs: np.ndarray, extras: np.ndarray) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(DIM, np.float32)
            self._dense[self.at] = self.weights
        sums = np.concatenate(([0.0], np.cumsum(self._dense[cols], dtype=np.float64)))
        return sums[offs[1:]] - sums[offs[:-1]] + extras @ self.extra + self.bias

    def probability(self, cols, offs, extras) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(cols, offs, extras), -30, 30)))


def fit(cols: np.ndarray, offs: np.ndarray, extras: np.ndarray, y: np.ndarray, steps: int = 150, l2: float = 1e-3, least: int = 4, z: float = 4.0) -> Linear:
    """Features that at least `least` rows have, and whose rate differs between the classes by
    z standard errors, are fitted by gradient steps with momentum, classes weighted
    equally."""
    n, rows = len(y), np.repeat(np.arange(len(y)), np.diff(offs))
    if not n or y.all() or not y.any():
        return Linear(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(extras.shape[1]), 4.0 if n and y.all() else -4.0)
    pos, neg = y.sum(), n - y.sum()
    p = np.bincount(cols, y[rows], DIM)
    q = np.bincount(cols, minlength=DIM) - p
    rate = (p + q) / n
    err = np.sqrt(np.maximum(rate * (1 - rate), 0.5 / n) * (1 / pos + 1 / neg))
    used = (p + q >= least) & (np.abs(p / pos - q / neg) > z * err)
    ids = np.flatnonzero(used)
    place = np.full(DIM, -1, np.int32)
    place[ids] = np.arange(len(ids))
    kept = used[cols]
    c, r = place[cols[kept]], rows[kept]
    w, b, e = np.zeros(len(ids)), 0.0, np.zeros(extras.shape[1])
    weight = np.where(y, 0.5 / pos, 0.5 / neg)
    state = [np.zeros(len(ids) + len(e) + 1), np.zeros(len(ids) + len(e) + 1)]
    for t in range(1, steps + 1):
        m = np.bincount(r, w[c], n) + extras @ e + b
        g = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y) * weight
        grad = np.concatenate((np.bincount(c, g[r], len(ids)) + l2 * w / max(1, len(ids)), g @ extras, [g.sum()]))
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        step = 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        w, e, b = w - step[: len(ids)], e - step[len(ids) : -1], b - step[-1]
    return Linear(ids, w.astype(np.float32), e, float(b))


def rows_of(cols, offs, pick: np.ndarray):
    parts = [cols[offs[i] : offs[i + 1]] for i in pick]
    return np.concatenate(parts or [np.zeros(0, np.int64)]), np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)


class Chain:
    """Models of the categories, in order."""

    def __init__(self, names: list[str], models: list[Linear]):
        self.names, self.models = names, models

    @classmethod
    def train(cls, cols, offs, targets: dict[str, np.ndarray], folds: int = FOLDS, seed: int = 5) -> Chain:
        n = len(offs) - 1
        fold = np.random.default_rng(seed).permutation(n) % folds
        extras, models, names = np.zeros((n, 0)), [], list(targets)
        for k, name in enumerate(names):
            y = targets[name].astype(bool)
            models.append(fit(cols, offs, extras, y))
            if k + 1 == len(names):
                break
            held = np.zeros(n)
            for f in range(folds):
                inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                model = fit(*rows_of(cols, offs, inside), extras[inside], y[inside])
                held[outside] = model.probability(*rows_of(cols, offs, outside), extras[outside])
            extras = np.column_stack((extras, held))
        return cls(names, models)

    def probabilities(self, cols, offs) -> dict[str, np.ndarray]:
        extras, out = np.zeros((len(offs) - 1, 0)), {}
        for name, model in zip(self.names, self.models):
            out[name] = model.probability(cols, offs, extras)
            extras = np.column_stack((extras, out[name]))
        return out


def train_chain(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chain=CHAIN, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Train on at most `sample` labelled rows, drawn by a hash of their id among those that can be
    used: rows with a null id, text or label, and texts over SAMPLE_BYTES, can't. Half of
    the places go to rows that are positive in the last category, if there are as many. Of
    rows that repeat an id one is used, whose text has the smallest hash; labels that
    repeat an id are positive if any of them is. One task of an executor fits the models on
    the sample, whose size is bounded; the driver gets their weights alone."""
    spark = docs.sparkSession
    bounded_batches(spark)
    last = chain[-1][0]
    names = [n for n, _, _ in chain]
    known = labels.select(F.col(id_col).alias("__id"), *((F.col(c) == v).alias(f"__y_{n}") for n, c, v in chain)).dropna()
    known = known.groupBy("__id").agg(*(F.max(f"__y_{n}").alias(f"__y_{n}") for n in names))
    usable = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= SAMPLE_BYTES))
    usable = usable.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    able = known.join(usable.select("__doc"), F.col("__id") == F.col("__doc"), "left_semi")
    draws = [able.where(F.col(f"__y_{last}") == p).orderBy(F.xxhash64("__id"), "__id").limit(sample // 2) for p in (True, False)]
    picked = F.broadcast(written(draws[0].union(draws[1]), "toxicity-sample"))  # at most `sample` rows
    texts = usable.join(picked, F.col("__doc") == F.col("__id"))
    texts = texts.groupBy("__id", *(f"__y_{n}" for n in names)).agg(F.min_by("__text", F.struct(F.xxhash64("__text"), "__text")).alias("__text"))

    def fitted(batches):
        parts, ids, ys = [], [], {n: [] for n in names}
        for b in batches:
            cols, offs = features(*text_buffers(b.column("__text")))
            parts += [cols[offs[i] : offs[i + 1]].astype(np.int32) for i in range(len(offs) - 1)]
            ids += b.column("__id").to_pylist()
            for n in names:
                ys[n] += b.column(f"__y_{n}").to_pylist()
        by = sorted(range(len(ids)), key=ids.__getitem__)
        offs = np.concatenate(([0], np.cumsum([len(parts[i]) for i in by]))).astype(np.int64)
        cols = np.concatenate([parts[i] for i in by] or [np.zeros(0, np.int32)])
        made = Chain.train(cols, offs, {n: np.array([ys[n][i] for i in by], bool) for n in names})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["chain"])

    made = texts.repartition(1).mapInArrow(fitted, "chain binary").first()
    return pickle.loads(bytes(made["chain"])) if made else Chain.train(np.zeros(0, np.int32), np.zeros(1, np.int64), {n: np.zeros(0, bool) for n in names})


def scored(docs: DataFrame, chain: Chain, keep: list[str], text_col: str = "text", only_clean: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """keep columns, then p_<category> of each and <last category> (boolean). Null and
    empty texts have no features: their probability is that of the biases, and they
    count as clean. Whole texts are read, however long; repeated rows are scored each. An
    empty table gives an empty result. only_clean: instead, rows of docs with their
    columns, without those of the last category."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # the weights of at most DIM features for each category
    last, names = chain.names[-1], chain.names

    def run(batches):
        for b in batches:
            data, offs = text_buffers(b.column(b.num_columns - 1))
            out: dict[str, list[np.ndarray]] = {n: [np.zeros(0)] for n in names}
            for i, j in row_slices(offs, 1 << 20):
                part = offs[i : j + 1]
                cols, at = features(data[part[0] : part[-1]], part - part[0])
                for n, p in sent.value.probabilities(cols, at).items():
                    out[n].append(p)
            p = {n: np.concatenate(x) for n, x in out.items()}
            bad = (p[last] >= threshold) & (np.diff(offs) > 0)
            if only_clean:
                yield b.filter(pa.array(~bad)).select(range(b.num_columns - 1))
            else:
                yield pa.RecordBatch.from_arrays([*(b.column(f"__k{i}") for i in range(len(keep))), *(pa.array(p[n]) for n in names), pa.array(bad)], names=[*keep, *(f"p_{n}" for n in names), last])

    if only_clean:
        return docs.select("*", F.col(text_col).alias("__text")).mapInArrow(run, docs.schema)
    rows = docs.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, kept + "".join(f", p_{n} double" for n in names) + f", `{last}` boolean")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train_chain(docs, table(spark, sf_dir, "labels")), ["doc_id"])
