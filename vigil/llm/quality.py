"""Quality classifier: gradient-boosted trees over histograms of document statistics.

Statistics are computed from whole texts inside tasks.  Trees are fitted on a
bounded sample of labelled rows (``SAMPLE_ROWS``), chosen by the hash of the
id, and scored everywhere: all trees are full binary trees of one depth, kept
as flat arrays, and numpy walks all of them for a block of rows at once.

Defined cases: null texts count as empty, and empty ones are scored like any
text; a document with several labels counts with the largest; rows with a null
id are scored and never learned from; repeated rows get equal scores and count
once in the sample; without labels, or with one class alone, every score is
the share of that class (0.5 without any); other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import map_texts, may_learn

#: Most labelled rows that the trees are fitted on.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, SHRINK = 60, 4, 0.2, 64, 10, 1.0

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "spread_word", "longest_word", "distinct_words",
    "top_word", "distinct_lines", "letters", "digits", "capitals", "blanks", "stops", "marks", "beyond_ascii",
    "words_with_marks", "byte_entropy",
)

_KIND = np.zeros(256, dtype=np.int64)  # 0 marks, 1 small letters, 2 capitals, 3 digits, 4 blanks, 5 stops, 6 others
_KIND[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 1
_KIND[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 2
_KIND[np.frombuffer(b"0123456789", np.uint8)] = 3
_KIND[np.frombuffer(b" \t\n\r\v\f", np.uint8)] = 4
_KIND[np.frombuffer(b".,;:?'\"()-", np.uint8)] = 5
_KIND[128:] = 6


def statistics(text: str | None) -> list[float]:
    """The ``STATISTICS`` of one whole text."""
    data = (text or "").encode()
    words, lines = data.split(), data.split(b"\n")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=7)
    size, n = max(len(data), 1), max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    often = Counter(words)
    shares = counts[counts > 0] / size
    ends = np.bincount([_KIND[w[-1]] for w in often], weights=list(often.values()), minlength=7) if words else kinds
    return [
        np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), lengths.max(),
        len(often) / n, max(often.values(), default=0) / n, len(set(lines)) / len(lines),
        (kinds[1] + kinds[2]) / size, kinds[3] / size, kinds[2] / max(kinds[1] + kinds[2], 1), kinds[4] / size,
        kinds[5] / size, kinds[0] / size, kinds[6] / size, ends[0] / n, float(-(shares * np.log2(shares)).sum()),
    ]


@dataclass(frozen=True)
class Trees:
    """Full binary trees: inner nodes by level, then leaves.  A row goes right where its value is above the limit."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # trees x inner nodes; infinite where a node is not divided
    leaf: np.ndarray  # trees x leaves


def walk(trees: Trees, rows: np.ndarray) -> np.ndarray:
    """Scores between 0 and 1 of rows of statistics, all trees of a block of rows at once."""
    out = np.empty(len(rows))
    number = np.arange(len(trees.feature))[None, :]
    for start in range(0, len(rows), 4096):
        block = rows[start : start + 4096]
        at = np.zeros((len(block), len(trees.feature)), dtype=np.int64)
        for _ in range(int(np.log2(trees.leaf.shape[1]))):
            value = np.take_along_axis(block, trees.feature[number, at], axis=1)
            at = 2 * at + 1 + (value > trees.limit[number, at])
        raw = trees.base + trees.leaf[number, at - trees.feature.shape[1]].sum(axis=1)
        out[start : start + 4096] = 1 / (1 + np.exp(-raw))
    return out


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees by gradient boosting of the logistic loss; splits come from histograms of gradients."""
    inner, leaves = 2**depth - 1, 2**depth
    share = labels.mean() if len(labels) else 0.5
    base = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
    if share in (0, 1) or not len(labels):
        trees = 0
    feature = np.zeros((trees, inner), dtype=np.int64)
    limit, leaf = np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    n, width = rows.shape
    cuts = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)] if trees else []
    binned = np.stack([np.searchsorted(c, rows[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if trees else None
    raw = np.full(n, base)
    for t in range(trees):
        chance = 1 / (1 + np.exp(-raw))
        slope, bend = chance - labels, chance * (1 - chance)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            cell = (((at - first)[:, None] * width + np.arange(width)) * BINS + binned).ravel()
            shape = nodes, width, BINS
            add = [np.bincount(cell, np.repeat(w, width), nodes * width * BINS).reshape(shape) for w in (slope, bend, np.ones(n))]
            left = [np.cumsum(a, axis=2) for a in add]
            right = [a[:, :, -1:] - a for a in left]
            parts = [g * g / (h + SHRINK) for g, h, _ in (left, right)]
            gain = parts[0] + parts[1] - (left[0] + right[0]) ** 2 / (left[1] + right[1] + SHRINK)
            gain[(left[2] < LEAST_LEAF) | (right[2] < LEAST_LEAF)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for node in np.flatnonzero(gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9):
                j, b = divmod(int(best[node]), BINS)
                feature[t, first + node], limit[t, first + node] = j, cuts[j][b]
            at = 2 * at + 1 + (rows[np.arange(n), feature[t, at]] > limit[t, at])
        place = at - inner
        slopes, bends = np.bincount(place, slope, leaves), np.bincount(place, bend, leaves)
        leaf[t] = -RATE * slopes / (bends + SHRINK)
        raw = raw + leaf[t][place]
    return Trees(base, feature, limit, leaf)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = SAMPLE_ROWS,
) -> Trees:
    """Trees from the labelled documents that may be learned from, ``rows`` of them at most.

    The chosen ids number ``rows`` at most and are broadcast; statistics are
    computed for the chosen documents alone, in Spark, and only these numbers
    come to the driver.
    """
    known = labels.where(may_learn(F.col(doc_id)) & F.col(label).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("double").alias("_label"))
    share = rows / max(known.count(), 1)
    hashed = known.withColumn("_hash", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)))
    if share < 1:
        hashed = hashed.where(F.col("_hash") < int((1 << 30) * share))
    chosen = F.broadcast(hashed.orderBy("_hash", "_id").limit(rows).select("_id", "_label"))
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(chosen, "_id")
    measured = describe(found, ["_id", "_label"]).groupBy("_id", "_label").agg(F.min("statistics").alias("_row"))
    got = sorted((r["_id"], r["_label"], r["_row"]) for r in measured.collect())
    return fit(np.array([r[2] for r in got]).reshape(-1, len(STATISTICS)), np.array([r[1] for r in got]))


def describe(df: DataFrame, kept: list[str], text: str = "text") -> DataFrame:
    """``kept`` and ``statistics`` (array of double) of each whole text."""
    return map_texts(df, kept, lambda: lambda texts: [[statistics(t) for t in texts]], "statistics array<double>", text)


def score(df: DataFrame, trees: Trees, kept: list[str], text: str = "text") -> DataFrame:
    """``kept`` and ``score`` of each whole text; higher means a label of 1 is likelier."""

    def make():
        def work(texts):
            found = np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS))
            return [walk(trees, found)]

        return work

    return map_texts(df, kept, make, "score double", text)
