"""Quality classifier: histogram gradient-boosted trees over document statistics.

Executors turn whole texts into a fixed vector of statistics. A bounded sample of labelled rows (SAMPLE, drawn by a
hash of doc_id) trains the trees in numpy: features are binned once, each level's histograms come from one bincount,
leaves take Newton steps on the logistic loss. All trees are complete and of one depth, flattened into arrays, so a
batch of documents walks a tree in depth vectorised steps.

Defined cases: null text is empty; an empty text has all statistics 0 and gets the score the trees give that; rows
without a label, with a null id or with a held-out id are never learned from; of several labels of one id all count;
with no labels at all every score is the prior 0.5; repeated rows each give a row; other columns are kept, but for one with
the name of a column that is added.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, free_names, make_room, small, without

SAMPLE = 16_000
FEATURES = (
    "log_bytes", "log_words", "word_len", "word_len_sd", "upper", "lower", "digit", "space", "non_ascii", "bang", "bar", "sign",
    "stop", "comma", "lines", "line_len", "distinct", "upper_words", "short_words", "top_word", "top_byte", "entropy", "repeat_lines",
    "no_letter_words", "end_sign_words", "mixed", "repeat_pairs",
)
_CLASS = np.zeros((256, 9))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [
        0x41 <= _b <= 0x5A, 0x61 <= _b <= 0x7A, 0x30 <= _b <= 0x39, _b in (9, 10, 11, 12, 13, 32), _b >= 0x80, _c == "!", _c == "|",
        _b < 0x80 and _c in "#$%&*@^~<>{}[]\\/=+_`", _c in ".?",
    ]
_KIND = np.zeros(256, dtype=np.uint8)  # 1: upper, 2: lower, 4: white space, 8: a letter of some kind, 16: a sign that ends a word
for _b in range(256):
    _KIND[_b] = (
        1 * (0x41 <= _b <= 0x5A) + 2 * (0x61 <= _b <= 0x7A) + 4 * (_b in (9, 10, 11, 12, 13, 32))
        + 8 * (0x41 <= _b <= 0x5A or 0x61 <= _b <= 0x7A or _b >= 0x80) + 16 * (chr(_b) in "!#$%&*|@^~=+_")
    )


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one text, in the order of FEATURES."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    hist = np.bincount(raw, minlength=256)
    words = data.split()
    m = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = hist[hist > 0] / n
    out[0], out[1] = np.log1p(n), np.log1p(m)
    out[4:13] = hist @ _CLASS / n
    out[13] = hist[0x2C] / n
    out[14] = len(lines) / n * 100
    out[15] = np.log1p(n / max(1, len(lines)))
    out[20], out[21] = p.max(), -(p * np.log2(p)).sum()
    out[22] = 1 - len(set(lines)) / max(1, len(lines))
    if m:
        kind = _KIND[raw]
        edge = np.flatnonzero(np.diff(kind & 4, prepend=4, append=4).astype(np.int8))
        starts, ends = edge[::2], edge[1::2]
        size = ends - starts
        seen = np.bitwise_or.reduceat(kind, starts)  # of each word and the space behind it
        counts = Counter(words)
        out[2], out[3] = size.mean(), size.std()
        out[16] = len(counts) / m
        out[17] = np.count_nonzero((seen & 3 == 1) & (size > 1)) / m
        out[18] = np.count_nonzero(size <= 3) / m
        out[19] = max(counts.values()) / m
        out[23] = np.count_nonzero(seen & 8 == 0) / m
        out[24] = np.count_nonzero(kind[ends - 1] & 16) / m
        out[25] = np.count_nonzero((kind[:-1] & 2).astype(bool) & (kind[1:] & 1).astype(bool)) / m
        out[26] = 1 - len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
    return out


@dataclass
class Trees:
    """Complete trees of one depth: inner nodes' features and thresholds, leaves' values; node i has 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            raw += v[at - len(f)]
        return 1 / (1 + np.exp(-raw))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 2.0, least: int = 8) -> Trees:
    """Fits the trees; x: rows x features, y: 0 or 1."""
    n, k = x.shape if len(x) else (0, len(FEATURES))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        mean = 0.5 if n == 0 else (y.sum() + 1) / (n + 2)
        return Trees(feature[:0], threshold[:0], value[:0], float(np.log(mean / (1 - mean))), depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)  # bin b: x <= edges[b]
    flat = binned + np.arange(k) * bins
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            cell = (flat + ((at - first) * k * bins)[:, None]).ravel()
            gs = np.bincount(cell, np.repeat(g, k), width * k * bins).reshape(width, k, bins).cumsum(2)
            hs = np.bincount(cell, np.repeat(h, k), width * k * bins).reshape(width, k, bins).cumsum(2)
            ns = np.bincount(cell, minlength=width * k * bins).reshape(width, k, bins).cumsum(2)
            gt, ht, nt = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(ns < least) | (nt - ns < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for node in range(width):
                j, b = divmod(int(best[node]), bins)
                if gain[node, j, b] > 1e-9 and b < len(edges[j]):
                    feature[t, first + node], threshold[t, first + node] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t][at]] > threshold[t][at])
        leaf = at - inner
        value[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        raw += value[t][leaf]
    return Trees(feature, threshold, value, base, depth)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> the same with stats, an array in the order of FEATURES; a column of that name gives way."""
    docs = without(docs, "stats")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            x = [statistics(t.as_py()) for t in batch.column("text")]
            yield batch.append_column("stats", pa.array(x, pa.list_(pa.float64())))

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, stats array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, sample: int = SAMPLE) -> Trees:
    """Trees from at most `sample` labelled rows whose crc32(id) mod modulus isn't `held`."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & (crc_mod(F.col("doc_id"), modulus) != held))
        .select("doc_id", F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    got = with_statistics(rows.select("doc_id", "text", "y")).select("doc_id", "y", "stats").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["y"], r["stats"]))
    return train(np.array([r["stats"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got], dtype=float))


def accept(docs: DataFrame, model: Trees, threshold: float) -> DataFrame:
    """The rows of docs whose score is the threshold or more, with all their columns."""
    (score,) = free_names(docs.columns, "score")
    return classify(docs, model, score).where(F.col(score) >= threshold).drop(score)


def classify(docs: DataFrame, model: Trees, column: str = "score") -> DataFrame:
    """docs (text, ...) -> the same columns and `column`: how likely label 1 is; an older column of that name gives way."""
    docs = without(docs, column)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in small(it):
            x = np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(batch.num_rows, len(FEATURES))
            yield batch.append_column(column, pa.array(model.score(x)))

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, `{column}` double")
