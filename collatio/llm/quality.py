"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): all pairwise interactions of the
active features in time linear in their number.

Features of a text: its words (hashed, log counts, unit length), structure statistics (one-hot bins) and metadata
columns (one-hot bins of the logarithm). Whole texts are read. The machine is fitted on a bounded sample of labelled
rows, the bound being the parameter ``max_rows``.

Defined results: a null text counts as empty; an empty text has no words and gets a score from its statistics; null or
negative metadata has a bin of its own; several labels of one document are averaged; of rows that repeat a
key the smallest is learnt from; with no labelled row, or with
labels of one kind only, the score is the (smoothed) share of label 1. Repeated rows get equal scores. Only the named
columns are read, so further columns of any name pass untouched.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_cores, as_bytes, bounded_batches, hash_below, lean, sample_rate

WORD_BITS = 14
WORDS = 1 << WORD_BITS
BINS = 16
STATISTICS = ("length", "words", "word_length", "upper", "digit", "symbol", "stop", "bang", "bar", "distinct", "repeat", "lines", "line_length", "line_repeat", "high", "longest_run")
MAX_METADATA = 4
FEATURES = WORDS + BINS * (len(STATISTICS) + MAX_METADATA)
_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = b"#$%&*@^~=+<>{}[]\\/_"


class Featurizer:
    """Sparse features of texts; remembers the hashes of words it has met, up to a bound."""

    def __init__(self, remember: int = 150_000):
        self.known: dict[bytes, int] = {}
        self.remember = remember

    def hashed(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.remember:
            known.clear()
        try:
            return np.array([known[w] for w in words], np.int32)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = zlib.crc32(w) & (WORDS - 1)
            return np.array([known[w] for w in words], np.int32)

    @staticmethod
    def statistics(raw: bytes, words: list[bytes], ids: np.ndarray) -> list[float]:
        n, k = max(1, len(raw)), max(1, len(words))
        share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
        lines = [x for x in raw.split(b"\n") if x.strip()]
        same = ids[1:] == ids[:-1]
        run, edges = 0, np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0])))) if len(same) else ()
        if len(edges):
            run = int((edges[1::2] - edges[::2]).max())
        return [
            math.log2(1 + len(raw)) / 20, math.log2(1 + len(words)) / 16, min(1, len(raw) / k / 20), share(_LETTERS[26:]) * 2, share(b"0123456789") * 4, share(_SYMBOLS) * 4,
            share(b".,;:?") * 8, share(b"!") * 8, share(b"|") * 8, len(set(words)) / k, float(same.mean()) if len(same) else 0.0, math.log2(1 + len(lines)) / 12,
            math.log2(1 + n / max(1, len(lines))) / 14, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(raw.translate(None, bytes(range(128, 256)))) / n, math.log2(1 + run) / 10,
        ]

    def __call__(self, raw: bytes, metadata: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
        words = raw.split()
        ids = self.hashed([w.lower() for w in words])
        own, counts = np.unique(ids, return_counts=True)
        weight = np.log1p(counts)
        weight /= max(1e-9, float(np.sqrt((weight * weight).sum())))
        bins = [WORDS + BINS * i + min(BINS - 1, int(max(0.0, s) * (BINS - 1) + (s > 0))) for i, s in enumerate(self.statistics(raw, words, ids))]
        for i, m in enumerate(metadata):
            at = 0 if m is None or m < 0 or m != m else min(BINS - 1, 1 + int(math.log2(1 + m) / 1.5))
            bins.append(WORDS + BINS * (len(STATISTICS) + i) + at)
        side = np.full(len(bins), 1 / math.sqrt(len(bins)))
        return np.concatenate((own, np.array(bins, np.int32))).astype(np.int32), np.concatenate((weight, side)).astype(np.float32)


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    metadata: tuple[str, ...] = ()

    def raw_scores(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of the rows whose features begin at ``starts`` (each row has at least its statistics)."""
        x = val[:, None]
        vx = self.v[idx] * x
        s = np.add.reduceat(vx, starts, axis=0)
        q = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * (s * s - q).sum(axis=1)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0] + [len(i) for i, _ in rows[:-1]])
        z = self.raw_scores(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, factors: int = 8, epochs: int = 12, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """Adagrad on the log loss, in mini-batches."""
    share = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
    model = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32), np.zeros((FEATURES, factors), np.float32))
    if not len(labels) or labels.min() == labels.max():
        return model
    rng = np.random.default_rng(seed)
    model.v = rng.normal(0, 0.05, (FEATURES, factors)).astype(np.float32)
    gw, gv, gb = np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, factors), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            sizes = np.array([len(rows[i][0]) for i in own])
            idx, val = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            vx = model.v[idx] * val[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            z = model.bias + np.add.reduceat(model.w[idx] * val, starts) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts, axis=0)).sum(axis=1)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]
            each = np.repeat(err, sizes).astype(np.float32) / len(own)
            seen, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, each * val, len(seen)).astype(np.float32) + decay * model.w[seen]
            grad = (each * val)[:, None] * (np.repeat(s, sizes, axis=0) - vx)
            dv = np.stack([np.bincount(back, grad[:, f], len(seen)) for f in range(factors)], 1).astype(np.float32) + decay * model.v[seen]
            gw[seen] += dw * dw
            gv[seen] += dv * dv
            model.w[seen] -= rate * dw / np.sqrt(gw[seen])
            model.v[seen] -= rate * dv / np.sqrt(gv[seen])
            db = float(err.mean())
            gb += db * db
            model.bias -= rate * db / math.sqrt(gb)
    return model


def _inputs(text: str, metadata: tuple[str, ...]):
    return [as_bytes(F.col(text)), *(F.col(m).cast("double") for m in metadata)]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = ("n_chars",), max_rows: int = 6000, max_bytes: int = 64 << 20, **options) -> FactorisationMachine:
    """Fitted on about ``max_rows`` labelled documents, or on about ``max_bytes`` of text, if that is less; chosen by the
    hash of the key. A key that repeats counts once, with its smallest text."""
    if len(metadata) > MAX_METADATA:
        raise ValueError(f"at most {MAX_METADATA} metadata columns")
    spark = docs.sparkSession
    bounded_batches(spark)
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    text_bytes = docs.agg(F.avg(F.octet_length(text)).alias("b")).first()["b"] or 1.0  # of a text, on average
    rate = sample_rate(marks.count(), min(max_rows, max(1, int(max_bytes / max(1.0, text_bytes)))))
    # at most about max_rows rows of two numbers: a proven bound for the broadcast
    chosen = F.broadcast(marks.where(hash_below(F.col("k"), rate)))
    columns = _inputs(text, metadata)
    named = [c.alias(f"c{i}") for i, c in enumerate(columns)]
    rows = docs.select(F.col(key).alias("k"), F.struct(*named).alias("row")).join(chosen, "k").groupBy("k", "y").agg(F.min("row").alias("row")).select("k", "y", "row.*")

    def features(batches):
        make = Featurizer()
        for b in batches:
            made = [make(raw, list(m)) for raw, *m in zip(*(b.column(i).to_pylist() for i in range(2, b.num_columns)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary())], ["k", "y", "idx", "val"])

    got = sorted(rows.mapInArrow(lean(features), f"k {dict(rows.dtypes)['k']}, y double, idx binary, val binary").collect(), key=lambda r: r["k"])
    sparse = [(np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"], np.float32)) for r in got]
    model = train(sparse, np.array([float(r["y"] >= 0.5) for r in got]), **options)
    model.metadata = tuple(metadata)
    return model


def score(docs: DataFrame, model: FactorisationMachine, text: str = "text", column: str = "quality_score") -> DataFrame:
    """docs with a column of scores from 0 to 1; every other column stays as it is."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded: FEATURES x (factors + 1) floats

    def scores(batches):
        make, machine = Featurizer(), shared.value
        for raw, *rest in batches:
            columns = [raw.to_pylist(), *(c.to_pylist() for c in rest)]
            yield pa.array(machine.scores([make(r[0], list(r[1:])) for r in zip(*columns, strict=True)]), pa.float64())

    def one(batches):
        yield from scores((b,) for b in batches)

    run = F.arrow_udf(lean(scores if model.metadata else one), "double", F.ArrowUDFType.SCALAR_ITER)
    return all_cores(docs).withColumn(column, run(*_inputs(text, model.metadata)))
