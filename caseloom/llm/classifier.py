"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The bracket is the sum over all pairs of features of <v_i, v_j> x_i x_j, in time linear in the features of a text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.base import add_columns, as_bytes, column

BUCKETS = 1 << 15  # of hashed words
RANK = 8
MAX_TRAIN_ROWS = 6_000  # bound of the labelled rows the machine is fitted on
EPOCHS = 20
BATCH = 256
CAPITALS = re.compile(rb"[A-Z]")
SYMBOL = re.compile(rb"[#*$%&|<>]")
N_STATS = 12


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, index: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One logit for each row of a ragged batch; every row has features."""
        linear = np.add.reduceat(self.weights[index] * values, starts)
        part = self.factors[index] * values[:, None]
        sums = np.add.reduceat(part, starts, axis=0)
        squares = np.add.reduceat(part * part, starts, axis=0)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)


def stats_of(data: bytes, words: list[bytes], counts: Counter, n_chars: int | None) -> list[float]:
    """Structure statistics and metadata (the table's own length column), each about 0 to 1."""
    n, size = max(len(words), 1), max(len(data), 1)
    rows = [x for x in data.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    stated = len(data) if n_chars is None else max(n_chars, 0)
    return [
        1.0,
        min(np.log1p(n) / 10, 2.0),
        min(sum(map(len, words)) / n / 10, 3.0),
        min(len(SYMBOL.findall(data)) / n, 3.0),
        min(data.count(b"!") / n, 3.0),
        len(CAPITALS.findall(data)) / size * 2,
        len(counts) / n,
        pairs / max(n - 1, 1),
        1 - len(set(rows)) / max(len(rows), 1),
        min(len(rows) / n * 5, 2.0),
        max(counts.values(), default=0) / n,
        min(np.log1p(stated) / 12, 2.0),
    ]


def features(data: bytes | None, n_chars: int | None, hashes: dict[bytes, int]) -> tuple[list[int], list[float]]:
    """Indices and values: hashed lower-case words with damped counts of unit length, then the statistics."""
    data = data or b""
    words = data.split()
    counts = Counter(data.lower().split())
    damped: dict[int, float] = {}
    for word, c in counts.items():
        h = hashes.get(word)
        if h is None:
            if len(hashes) > 200_000:
                hashes.clear()
            h = hashes[word] = zlib.crc32(word) % BUCKETS
        damped[h] = damped.get(h, 0.0) + 1.0 + np.log(c)
    norm = np.sqrt(sum(v * v for v in damped.values())) or 1.0
    stats = stats_of(data, words, counts, n_chars)
    return [*damped, *range(BUCKETS, BUCKETS + N_STATS)], [*(v / norm for v in damped.values()), *stats]


def is_held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(column(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, doc_id: str, text: str, label: str) -> DataFrame:
    """At most ``max_rows`` labelled rows that are not held out, drawn by a hash of the id, each id once."""
    marks = labels.select(column(doc_id).alias("_id"), column(label).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)")
    marks = marks.filter(~is_held_out("_id")).groupBy("_id").agg(F.max("_y").alias("_y"))
    drawn = marks.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    own = docs.filter(~is_held_out(doc_id)).select(column(doc_id).alias("_id"), column(text).alias("_t"), n_chars_of(docs).alias("_c"))
    return own.join(F.broadcast(drawn), "_id").dropDuplicates(["_id"])  # max_rows ids at most


def n_chars_of(docs: DataFrame):
    return column("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 0) -> Machine:
    """Adaptive gradient descent on the log loss. ``rows``: indices, values and label of each training row."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + N_STATS
    m = Machine(0.0, np.zeros(size, "f4"), rng.normal(0, 0.05, (size, RANK)).astype("f4"))
    if not rows:
        return m
    share = (sum(y for *_, y in rows) + 1) / (len(rows) + 2)
    m.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v, seen_b = np.full(size, 1e-2, "f4"), np.full((size, RANK), 1e-2, "f4"), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            part = [rows[i] for i in order[start : start + BATCH]]
            lengths = np.array([len(p[0]) for p in part])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            index, values = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            y = np.array([p[2] for p in part], "f4")
            z = np.clip(m.logits(index, values, starts), -30, 30)
            g = (1 / (1 + np.exp(-z)) - y) / len(part)
            each = np.repeat(g, lengths).astype("f4") * values
            sums = np.add.reduceat(m.factors[index] * values[:, None], starts, axis=0)
            grad_v = each[:, None] * (np.repeat(sums, lengths, axis=0) - m.factors[index] * values[:, None])
            used, place = np.unique(index, return_inverse=True)
            gw = np.bincount(place, each, len(used)).astype("f4") + 1e-5 * m.weights[used]
            gv = np.stack([np.bincount(place, grad_v[:, f], len(used)) for f in range(RANK)], axis=1).astype("f4") + 1e-5 * m.factors[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            m.weights[used] -= 0.2 * gw / np.sqrt(seen_w[used])
            m.factors[used] -= 0.05 * gv / np.sqrt(seen_v[used])
            seen_b += float(g.sum()) ** 2
            m.bias -= 0.1 * float(g.sum()) / np.sqrt(seen_b)
    return m


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> Machine:
    """Fit on a bounded sample. Features are made where the rows are; what reaches the driver is at most ``max_rows``
    rows of distinct hashed words."""
    rows = training_rows(docs, labels, max_rows, doc_id, text, label)

    def make():
        hashes: dict[bytes, int] = {}

        def compute(texts, chars):
            made = [features(t.as_py(), c.as_py(), hashes) for t, c in zip(texts, chars, strict=True)]
            return [[np.array(i, "i4") for i, _ in made], [np.array(v, "f4") for _, v in made]]

        return compute

    made = add_columns(rows, [as_bytes("_t"), F.col("_c")], "_i array<int>, _v array<float>", make, ["_id", "_y"]).toPandas()
    made = made.sort_values("_id")
    return fit([(np.asarray(i, "i4"), np.asarray(v, "f4"), int(y)) for i, v, y in zip(made["_i"], made["_v"], made["_y"], strict=True)])


def score(
    docs: DataFrame, machine: Machine, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Null and empty texts are scored by their statistics; a null id is held out. Columns of these names are replaced;
    rows are independent, so repeated rows get equal scores. Without training rows every score is near 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS x (RANK + 1) numbers

    def make():
        model = shared.value
        hashes: dict[bytes, int] = {}

        def compute(texts, chars):
            scores = []
            for t, c in zip(texts, chars, strict=True):
                i, v = features(t.as_py(), c.as_py(), hashes)
                z = model.logits(np.array(i), np.array(v, "f4"), np.array([0]))[0]
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            return [scores, [int(s >= threshold) for s in scores]]

        return compute

    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != "held_out"]
    base = docs.withColumn("held_out", is_held_out(doc_id))
    return add_columns(base, [as_bytes(text), n_chars_of(docs)], "score double, predicted int", make, [*kept, "held_out"])
