"""Content and boilerplate by line: a linear-chain conditional random field.

A text is a sequence of its lines. Each line has a few bucketed features; the
field weighs features per label and label pairs of neighbouring lines. Viterbi
decoding gives the best labels of a whole text, and a text is kept if content
lines hold at least ``SHARE`` of its characters.

The field is trained on labelled documents: lines of good ones are content;
lines of bad ones begin as boilerplate and, after a first fit, those the field
itself takes for content become content, as bad documents also hold sound
lines. Training reads at most ``rows_per_class`` labelled ids of either class
that have at most ``LINES`` lines; decoding reads every whole text.

The plain rules (few words, words in repeated windows) come first and the
field only judges what passes them.

Defined cases: a null text has no words and fails; a text of blank lines too;
without labels of both classes every line is content; rows are independent, so
repeated or null ids, ties and extra columns change nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import map_columns
from barlake.llm.samples import labelled

# The symbols counted, the characters that separate words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
ROWS_PER_CLASS, LINES, SHARE = 1500, 200, 0.5

# Upper bounds of the buckets of each feature; one more bucket lies above the last.
BUCKETS = {
    "words": (0, 1, 3, 7, 15, 31, 63), "symbols": (0.0, 0.01, 0.04), "upper": (0.05, 0.3), "distinct": (0.2, 0.5, 0.8),
    "digits": (0.0, 0.05, 0.2), "word_length": (2.5, 4, 6, 9), "marks": (0.0, 0.3), "ends": (0,), "repeated": (0,),
}
OFFSETS = np.concatenate([[0], np.cumsum([len(b) + 1 for b in BUCKETS.values()])])
FEATURES = int(OFFSETS[-1])
EDGES = [np.array(b, float) for b in BUCKETS.values()]


def repeated_words(words: list) -> int:
    """Words inside windows of five that are found twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    upto = total = 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return total


def line_figures(lines: list[str]) -> np.ndarray:
    """One row per line: the figures that BUCKETS cuts up."""
    out, seen = np.zeros((len(lines), len(BUCKETS))), set()
    for k, line in enumerate(lines):
        words = line.split()
        n, size = len(words), max(1, len(line))
        if not n:
            continue
        out[k] = (
            n, sum(map(line.count, SYMBOLS)) / size, sum(map(str.isupper, words)) / n, len(set(words)) / n,
            sum(map(line.count, "0123456789")) / size, (size - line.count(" ")) / n, line.count("!!") / n,
            words[-1][-1] in ".!?\"'", line in seen,
        )
        seen.add(line)
    return out


def features(figures: np.ndarray) -> np.ndarray:
    """Feature numbers of each line, one per kind of figure."""
    return np.column_stack([OFFSETS[i] + np.searchsorted(edges, figures[:, i], side="left") for i, edges in enumerate(EDGES)])


class Field:
    """Weights per label and feature, and per pair of labels; label 1 is content."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((FEATURES, 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def viterbi(self, found: np.ndarray) -> np.ndarray:
        """The best labels of one text; ties go to content."""
        scores = self.emit[found].sum(1)
        n = len(scores)
        (m00, m01), (m10, m11) = self.move.tolist()
        back, (a, b) = [], scores[0].tolist()
        for x, y in scores[1:].tolist():
            from0, from1 = b + m10 >= a + m00, b + m11 >= a + m01
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00) + x, (b + m11 if from1 else a + m01) + y
        labels = np.ones(n, np.int8)
        label = int(b >= a)
        for k in range(n - 1, 0, -1):
            labels[k] = label
            label = int(back[k - 1][label])
        labels[0] = label
        return labels

    def fit(self, texts: list[np.ndarray], labels: list[np.ndarray], steps: int = 120, rate: float = 0.2, ridge: float = 1e-3) -> Field:
        """Gradient steps on the penalised likelihood, all texts at once, forward and backward along the lines."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        size, n = len(texts[order[0]]), len(texts)
        found, gold, mask = np.zeros((n, size, len(BUCKETS)), np.int64), np.zeros((n, size), np.int64), np.zeros((n, size), bool)
        for row, i in enumerate(order):
            k = len(texts[i])
            found[row, :k], gold[row, :k], mask[row, :k] = texts[i], labels[i], True
        live = mask.sum(0)  # texts are longest first, so those that reach line k are the first live[k]
        total = mask.sum()
        want_emit = np.stack([np.bincount(found[mask & (gold == y)].ravel(), minlength=FEATURES) for y in (0, 1)], 1)
        pairs = mask[:, 1:]
        want_move = np.bincount((gold[:, :-1] * 2 + gold[:, 1:])[pairs], minlength=4).reshape(2, 2)
        mean, square = [np.zeros_like(self.emit), np.zeros_like(self.move)], [np.zeros_like(self.emit), np.zeros_like(self.move)]
        flat = found[mask]
        for step in range(1, steps + 1):
            scores = self.emit[found].sum(2)
            ahead, behind = np.zeros((n, size, 2)), np.zeros((n, size, 2))
            ahead[:, 0] = scores[:, 0]
            for k in range(1, size):
                at = slice(0, live[k])
                ahead[at, k] = np.logaddexp(ahead[at, k - 1, 0:1] + self.move[0], ahead[at, k - 1, 1:2] + self.move[1]) + scores[at, k]
            for k in range(size - 2, -1, -1):
                at = slice(0, live[k + 1])
                after = scores[at, k + 1] + behind[at, k + 1]
                behind[at, k] = np.logaddexp(after[:, 0:1] + self.move[:, 0], after[:, 1:2] + self.move[:, 1])
            norm = np.logaddexp(*(ahead + behind)[:, 0].T)
            share = np.exp(ahead + behind - norm[:, None, None])[mask]
            have_emit = np.stack([np.bincount(flat.ravel(), weights=np.repeat(share[:, y], flat.shape[1]), minlength=FEATURES) for y in (0, 1)], 1)
            joint = ahead[:, :-1, :, None] + self.move + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - norm[:, None, None, None]
            have_move = np.exp(joint[pairs]).sum(0)
            for k, (name, want, have) in enumerate((("emit", want_emit, have_emit), ("move", want_move, have_move))):
                weights = getattr(self, name)
                slope = (want - have) / total - ridge * weights
                mean[k] = 0.9 * mean[k] + 0.1 * slope
                square[k] = 0.99 * square[k] + 0.01 * slope**2
                setattr(self, name, weights + rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8))
        return self


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, most_lines: int = LINES) -> Field | None:
    """A trained field; None without labelled texts of both classes."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            lines = [t.split("\n") for t in batch["text"]]
            short = [i for i, x in enumerate(lines) if len(x) <= most_lines]
            yield {
                "doc_id": [batch["doc_id"][i] for i in short], "label": [batch["label"][i] for i in short],
                "found": [features(line_figures(lines[i])).ravel().tolist() for i in short],
            }

    sample = labelled(docs, labels, rows_per_class)
    rows = sorted(tuple(r) for r in map_columns(sample.select("doc_id", "label", "text"), run, "doc_id long, label int, found array<int>").collect())
    found = [np.array(r[2], np.int64).reshape(-1, len(BUCKETS)) for r in rows]
    good = [r[1] == 1 for r in rows]
    if all(good) or not any(good):
        return None
    marks = [np.full(len(x), int(g)) for x, g in zip(found, good, strict=True)]
    field = Field().fit(found, marks)
    again = [m if g else field.viterbi(x).astype(int) for x, m, g in zip(found, marks, good, strict=True)]
    return Field(field.emit.copy(), field.move.copy()).fit(found, again, steps=60)


def content_share(field: Field | None, text: str) -> float:
    """Share of a text's characters that lie in content lines."""
    lines = text.split("\n")
    sizes = np.array([len(x) for x in lines])
    if field is None or not sizes.sum():
        return 1.0
    return float(sizes[field.viterbi(features(line_figures(lines))) == 1].sum() / sizes.sum())


def judge(docs: DataFrame, field: Field | None, share: float = SHARE, text: Column | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")}
            for text in batch["text"]:
                words = text.encode().split()
                lines = [x for x in text.split("\n") if x.strip(SPACES)]
                repeats = repeated_words(words)
                failed = len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED * len(words)
                content = content_share(field, text) if words else 0.0
                values = (
                    len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
                    repeats, failed, not failed and content >= share, content,
                )
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            yield {"doc_id": batch["doc_id"], **out}

    text = F.col("text") if text is None else text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return map_columns(
        rows, run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double",
    )
