"""Quality scores from how well good and bad text compress a text.

Two zstandard dictionaries of one size are built from slices of good and bad
labelled texts. A text is compressed with either and with none; the difference
of the sizes, set against their sum and the text's length, is what tells the
classes apart. A logistic curve over that difference, the plain compressed
share and the length, fitted on labelled texts that no dictionary has seen,
turns it into a probability.

Bounds of fitting, all parameters: ``rows_per_class`` labelled ids of either
class, ``slices`` slices of ``SLICE`` bytes of a text for the dictionaries, and
one row of figures per text for the curve. Scoring reads every whole text.

Defined cases: a null or empty text is scored as the empty text; a null id
isn't held out; without labels of both classes the score is the share of label
1 (1.0 without any label); repeated rows get one score each; extra columns of
the tables change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import filter_rows, kept, map_columns, utf8
from barlake.llm.samples import held_out, labelled

ROWS_PER_CLASS = 3000
DICTIONARY_BYTES = 65536
SLICE, SLICES = 256, 16
LEVEL = 3
THRESHOLD = 0.3
FIGURES = "normal double, by_length double, plain double, size double"


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def scores(self, figures: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(figures), float(self.mean[0]))
        return _curve(_design(figures, self.mean, self.spread) @ self.weights)


def _curve(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _design(figures: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    x = np.clip((figures - mean) / spread, -6, 6)
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i + 1)]
    return np.column_stack([np.ones(len(x)), x, *pairs])


class Compressors:
    """Sizes of texts with the good, the bad and no dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def compressor(data: bytes | None):
            options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if not data:
                return zstandard.ZstdCompressor(**options)
            trained = zstandard.ZstdCompressionDict(data)
            trained.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=trained, **options)

        self.each = [compressor(good), compressor(bad), compressor(None)]

    def figures(self, text: bytes) -> tuple[float, float, float, float]:
        good, bad, plain = (len(c.compress(text)) for c in self.each)
        n = len(text) + 1
        return (bad - good) / (bad + good), (bad - good) / n, plain / n, math.log(n)


def _slices(sample: DataFrame, slices: int) -> dict[int, list[bytes]]:
    """Evenly spread slices of the sampled texts, by label; at most ``slices`` of each."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "label": [], "part": []}
            for doc_id, label, text in zip(batch["doc_id"], batch["label"], batch["text"], strict=True):
                starts = range(0, max(len(text), 1), SLICE)
                for k in range(min(slices, len(starts))):
                    at = starts[k * len(starts) // min(slices, len(starts))]
                    out["doc_id"].append(doc_id)
                    out["label"].append(label)
                    out["part"].append(text[at:at + SLICE])
            yield out

    rows = map_columns(sample.select("doc_id", "label", utf8(F.col("text")).alias("text")), run, "doc_id long, label int, part binary").collect()
    found: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sorted(rows):
        found[row.label].append(bytes(row.part))
    return found


def _dictionary(parts: list[bytes], size: int) -> bytes:
    """A trained dictionary; of the slices themselves where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def _figures(rows: DataFrame, good: bytes, bad: bytes, keep: str, schema: str) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        compressors = Compressors(good, bad)
        for batch in batches:
            columns = zip(*map(compressors.figures, batch["text"]), strict=True)
            yield {keep: batch[keep], **dict(zip(("normal", "by_length", "plain", "size"), columns, strict=True))} if batch["text"] else {
                c: [] for c in (keep, "normal", "by_length", "plain", "size")
            }

    return map_columns(rows, run, schema)


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, size: int = DICTIONARY_BYTES, slices: int = SLICES) -> Model:
    sample = labelled(docs, labels, rows_per_class)
    to_dictionary = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) < 3
    parts = _slices(sample.where(to_dictionary), slices)
    flat = Model(b"", b"", np.ones(1), np.ones(1), np.zeros(0))
    good, bad = _dictionary(parts[1], size), _dictionary(parts[0], size)
    rest = sample.where(~to_dictionary).select("label", utf8(F.col("text")).alias("text"))
    found = sorted(tuple(r) for r in _figures(rest, good, bad, "label", f"label int, {FIGURES}").collect())
    y = np.array([r[0] for r in found], float)
    if not parts[0] or not parts[1] or len(set(y)) < 2:
        every = [*y, *([0.0] * len(parts[0])), *([1.0] * len(parts[1]))]
        flat.mean = np.array([float(np.mean(every)) if every else 1.0])
        return flat
    x = np.array([r[1:] for r in found])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    return Model(good, bad, mean, spread, _logistic(_design(x, mean, spread), y))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Penalised maximum likelihood by Newton steps, halved until they help."""
    def loss(w: np.ndarray) -> float:
        z = np.clip(x @ w, -30, 30)
        return float(np.sum(np.log1p(np.exp(z)) - y * z) + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _curve(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        scale = 1.0
        while scale > 1e-4 and loss(w - scale * step) > loss(w):
            scale /= 2
        w = w - scale * step
        if scale * np.abs(step).max() < 1e-6:
            break
    return w


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def score(rows: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) from (doc_id, text)."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        compressors = Compressors(model.good, model.bad)
        for batch in batches:
            found = model.scores(np.array([compressors.figures(t) for t in batch["text"]]).reshape(len(batch["text"]), 4))
            yield {"doc_id": batch["doc_id"], "score": found.tolist(), "predicted": (found >= threshold).astype(int).tolist()}

    return map_columns(rows.select("doc_id", utf8(F.col("text")).alias("text")), run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least the threshold, with their columns."""
    model = fit(docs, labels)

    def good(texts: list) -> list[bool]:
        compressors = kept(("compressors", model.good, model.bad), lambda: Compressors(model.good, model.bad))
        figures = [compressors.figures((t or "").encode()) for t in texts]
        return (model.scores(np.array(figures).reshape(len(texts), 4)) >= threshold).tolist()

    return filter_rows(docs, "text", good)
