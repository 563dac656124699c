"""Compression classifier of text quality.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is cut into short pieces and
each piece is compressed on its own with both dictionaries; the dictionary whose text it resembles saves more bytes.
The normalised difference of the two compressed sizes (and the two ratios themselves, which tell repetitive text from
prose) goes through a logistic curve fitted on labelled rows that built no dictionary.

Bounds of the learning sample (documented parameters): ``per_class`` documents per label for the dictionaries and as
many for the calibration, chosen by hash of the id; a document gives at most ``pieces`` pieces to a dictionary, spread
evenly over it. Scoring covers every byte of every text, short pieces or not.

Defined results: NULL or empty text gets the calibrated prior of an empty text (the curve at zero features, a constant);
several labels of one id count as several rows; NULL ids and NULL labels teach nothing; with a label missing from the
learning rows every score is the share of label 1 (0.5 when there are none). Repeated rows score alike.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import batch, batches_of, bounded_sample, fold, held_out, materialise, slices, utf8


@dataclass(frozen=True)
class Model:
    good: bytes | None            # dictionaries; None: the constant score ``bias``
    bad: bytes | None
    weights: tuple[float, ...]
    bias: float
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    piece: int
    level: int


def pieces(data: bytes, size: int) -> list[bytes]:
    return [data[i:i + size] for i in range(0, len(data), size)]


class Sizer:
    """Compressed sizes of a text under both dictionaries, piece by piece."""

    def __init__(self, good: bytes, bad: bytes, piece: int, level: int) -> None:
        self.piece = piece
        self.by = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_dict_id=False))

    def features(self, text: str | None) -> tuple[float, ...]:
        """(normalised difference, its value per byte, log ratio) from the sizes under good and bad."""
        data = utf8(text or "")
        if not data:
            return 0.0, 0.0, 0.0
        good, bad = (sum(len(c.compress(p)) for p in pieces(data, self.piece)) for c in self.by)
        return (bad - good) / (bad + good), (bad - good) / len(data), float(np.log(min(good, bad) / len(data)))


def spread(data: bytes, size: int, per_text: int) -> list[bytes]:
    """At most ``per_text`` pieces, evenly spaced over the whole text."""
    cut = pieces(data, size)
    n = min(per_text, len(cut))
    return [cut[i * len(cut) // n] for i in range(n)]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:                    # too few samples to train on: the text itself is the dictionary
        return b"".join(samples)[-size:] or b"\n" * 8


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) / len(y) + ridge * np.append(w[:-1], 0)
        hess = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag([ridge] * (len(w) - 1) + [1e-9])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, dictionary: int = 110 << 10,
        piece: int = 256, per_text: int = 16, level: int = 3) -> Model:
    """Learn from labelled rows outside the held-out fold. The fold's other two parts are used for one thing each:
    remainder 0 trains the dictionaries, remainder 2 the calibration."""
    known = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y"))
             .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).withColumn("part", fold(F.col("id"))).filter("part <> 1")
             .withColumn("cell", F.col("part") * 2 + F.col("y")))
    chosen = bounded_sample(known, "cell", "id", per_class)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(chosen), F.col("doc") == F.col("id"))         # at most about 4 x per_class rows
            .select("id", "text", "y", "part"))
    rows = materialise(rows)

    def sampled(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([spread(utf8(t or ""), piece, per_text) for t in b.column("text").to_pylist()], pa.list_(pa.binary()))], ["id", "y", "pieces"])

    taken = sorted((r.id, r.y, [bytes(p) for p in r.pieces]) for r in rows.filter("part = 0").mapInArrow(sampled, "id long, y int, pieces array<binary>").collect())     # per_text pieces a document
    samples = {y: [p for _, of, cut in taken if of == y for p in cut] for y in (0, 1)}
    seen = rows.groupBy("part", "y").count().collect()
    if not samples[0] or not samples[1] or len({r.y for r in seen if r.part == 2}) < 2:
        n = sum(r["count"] for r in seen)
        return Model(None, None, (), sum(r["count"] for r in seen if r.y == 1) / n if n else 0.5, (), (), piece, level)
    good, bad = (train_dictionary(samples[y], dictionary) for y in (1, 0))
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))             # two dictionaries of a fixed size

    def measured(batches):
        sizer = Sizer(*shared.value, piece, level)
        for b in slices(batches):
            x = [list(sizer.features(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["id", "y", "x"])

    held = sorted((r.id, list(r.x), r.y) for r in rows.filter("part = 2").mapInArrow(measured, "id long, y int, x array<double>").collect())          # three numbers a document
    x = np.array([h[1] for h in held])
    y = np.array([h[2] for h in held], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / scale, -6, 6)
    w, b = logistic(np.hstack([z, z * z]), y)
    return Model(good, bad, tuple(w), b, tuple(mean), tuple(scale), piece, level)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (higher: label 1 likelier), predicted; every whole text, by the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)      # two dictionaries of a fixed size

    def run(batches):
        m = shared.value
        sizer = Sizer(m.good, m.bad, m.piece, m.level) if m.good is not None else None

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            if sizer is None:
                s = np.full(b.num_rows, m.bias)
            else:
                x = np.array([sizer.features(t) for t in b.column("text").to_pylist()])
                z = np.clip((x - np.array(m.mean)) / np.array(m.scale), -6, 6)
                s = 1 / (1 + np.exp(-np.clip(np.hstack([z, z * z]) @ np.array(m.weights) + m.bias, -30, 30)))
            return batch(doc_id=b.column("doc_id"), score=pa.array(s), predicted=pa.array((s >= 0.5).astype("int32")))
        return batches_of(one)(batches)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Fit and score: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, **params))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
