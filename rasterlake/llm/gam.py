"""Quality classifier: a generalised additive model with pairwise interactions.

Text features are binned at quantiles. Every feature owns a lookup table over its bins; the strongest pairs own a table over
coarser bins of both. Cyclic boosting visits the tables in turn, each time fitting a shallow regression tree to the logistic
gradients and adding its leaves to the table. A score is the sum of table entries, so scoring is vectorised bin addition.

The tables are learned on a bounded sample of labelled rows (``sample`` rows with the lowest hash of their id); features and
scores cover every row and whole texts.

Edge cases: null and empty texts have all-zero features and are scored like any other; a label counts only if it is 0 or 1,
and an id with several labels takes the lowest; a null id is scored but never learned from; repeated rows are scored row by
row; with no label, or one class only, every score is the smoothed prior; a very long text is one pass, in memory that grows with
it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .runtime import table, tidy

FEATURES = (
    "log_words", "word_length", "long_words", "short_words", "symbols", "bars", "exclamations", "uppercase", "upper_words",
    "digits", "punctuation", "non_ascii", "dup_lines", "repeat_words", "distinct_words", "line_words", "adjacent_equal",
    "byte_entropy", "vowels", "sentence_ends", "word_entropy",
)


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _BAR, _BANG, _DIGIT = _is(b"#*$%&<>~^=+_\\@"), _is(b"|"), _is(b"!?"), _is(b"0123456789")
_UPPER, _LETTER = _is(bytes(range(65, 91))), _is(bytes([*range(65, 91), *range(97, 123)]))
_PUNCT, _END, _VOWEL, _HIGH = _is(b",;:'\"()-/"), _is(b".!?"), _is(b"aeiouAEIOU"), _is(bytes(range(0xC2, 0xF5)))


def features(texts: pa.LargeStringArray) -> np.ndarray:
    """Documents x FEATURES."""
    w = T.words(texts)
    n = len(w.bounds) - 1
    nb = np.maximum(np.diff(w.offsets), 1)
    nw = w.counts
    some = np.maximum(nw, 1)
    size = w.ends - w.starts
    share = lambda lut: w.per_doc_bytes(lut[w.buf]) / nb
    upper = np.concatenate([[0], np.cumsum(_UPPER[w.buf] | _is(bytes([0xC3]))[w.buf])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[w.buf] | _is(bytes([0xC3]))[w.buf])])
    caps = (upper[w.ends] - upper[w.starts] == letters[w.ends] - letters[w.starts]) & (letters[w.ends] - letters[w.starts] > 1)
    doc = w.doc
    key = doc.astype(np.int64) * 256
    code = np.bincount(np.repeat(np.arange(n), np.diff(w.offsets)) * 256 + w.buf, minlength=n * 256).reshape(n, 256)
    ent = np.log2(nb) - (code * np.log2(np.maximum(code, 1))).sum(1) / nb
    k = w.ids ^ T.mix(doc.astype(np.uint64) + np.uint64(1))
    _, at, cnt = np.unique(k, return_index=True, return_counts=True)
    distinct = np.bincount(doc[at], minlength=n) if len(at) else np.zeros(n)
    went = np.log2(some) - (np.bincount(doc[at], cnt * np.log2(cnt), n) if len(at) else np.zeros(n)) / some
    same = np.zeros(len(w.ids), bool)
    same[1:] = (w.ids[1:] == w.ids[:-1]) & (doc[1:] == doc[:-1])
    ld, _, _ = T.lines(w)
    n_lines = np.maximum(np.bincount(ld, minlength=n), 1)
    del key
    out = np.stack([
        np.log1p(nw), w.per_doc(size) / some, w.per_doc(size > 12) / some, w.per_doc(size < 4) / some, share(_SYMBOL), share(_BAR), share(_BANG),
        share(_UPPER), w.per_doc(caps) / some, share(_DIGIT), share(_PUNCT), share(_HIGH), T.dup_lines(w) / n_lines, T.repeat_words(w) / some,
        distinct / np.sqrt(some), np.log1p(nw / n_lines), w.per_doc(same) / some, ent, share(_VOWEL), share(_END), went,
    ], 1)
    out[nw == 0] = 0
    return out.astype(np.float32)


@dataclass
class Model:
    prior: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        z = np.full(len(x), self.prior)
        for j, t in enumerate(self.tables):
            z += t[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _best_cut(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    """Gain and position of the best cut of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g), np.cumsum(h)
    left_g, left_h = cg[:-1], ch[:-1]
    right_g, right_h = cg[-1] - left_g, ch[-1] - left_h
    gain = np.where((left_h > 1) & (right_h > 1), left_g**2 / (left_h + lam) + right_g**2 / (right_h + lam) - cg[-1] ** 2 / (ch[-1] + lam), 0)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, lam: float) -> np.ndarray:
    """Leaf value of every bin, of a tree grown best-first to so many leaves."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b], lam), i) for i, (a, b) in enumerate(parts)]
        gain, at, i = max(cuts)
        if gain <= 1e-9:
            break
        a, b = parts.pop(i)
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + lam)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """Best two-level tree on a pair's grid: one cut of either feature, then one cut of the other in each half."""
    best, out = 0.0, np.zeros_like(g)
    total = g.sum() ** 2 / (h.sum() + lam)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(gg)):
            gain, grid = -total, np.zeros_like(gg)
            for rows in (slice(0, cut), slice(cut, None)):
                a, b = gg[rows].sum(0), hh[rows].sum(0)
                leaf = _tree(a, b, 2, lam)
                grid[rows] = leaf
                gain += float((leaf * (2 * a - (b + lam / max(len(a), 1)) * leaf)).sum())
            if gain > best:
                best, out = gain, grid.T if flip else grid
    return best, out


def train(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 120, rate: float = 0.1, leaves: int = 3, pairs: int = 8, pair_bins: int = 8, pair_rounds: int = 20, lam: float = 2.0) -> Model:
    """Fit the lookup tables by cyclic boosting."""
    f = x.shape[1]
    prior = (y.sum() + 1) / (len(y) + 2)
    edges = [_edges(x[:, j], bins) for j in range(f)]
    coarse = [_edges(x[:, j], pair_bins) for j in range(f)]
    m = Model(float(np.log(prior / (1 - prior))), edges, [np.zeros(len(e) + 1) for e in edges], [], coarse, [])
    if not 0 < y.sum() < len(y):
        return m
    b = [np.searchsorted(edges[j], x[:, j], "right") for j in range(f)]
    z = np.full(len(y), m.prior)
    for _ in range(rounds):
        for j in range(f):
            p = 1 / (1 + np.exp(-z))
            size = len(m.tables[j])
            step = rate * _tree(np.bincount(b[j], y - p, size), np.bincount(b[j], p * (1 - p), size), leaves, lam)
            m.tables[j] += step
            z += step[b[j]]
    c = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(f)]
    grid = lambda i, j, v: np.bincount(c[i] * (len(coarse[j]) + 1) + c[j], v, (len(coarse[i]) + 1) * (len(coarse[j]) + 1)).reshape(len(coarse[i]) + 1, -1)
    p = 1 / (1 + np.exp(-z))
    ranked = sorted(((_pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)), lam)[0], i, j) for i in range(f) for j in range(i)), reverse=True)
    m.pairs = [(i, j) for gain, i, j in ranked[:pairs] if gain > 0]
    m.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in m.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(m.pairs, m.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            step = rate * _pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)), lam)[1]
            t += step
            z += step[c[i], c[j]]
    return m


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and an array of features for every row, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = T.text_column(batch.column(1))
            for lo, hi in T.slices(texts):
                x = features(texts.slice(lo, hi - lo))
                arr = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), arr], ["doc_id", "x"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) t").mapInArrow(tidy(run), "doc_id long, x array<float>")


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(feats: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = 30_000) -> Model:
    """Learn from at most ``sample`` labelled rows outside the held-out fold."""
    known = (
        labels.selectExpr("cast(doc_id as long) doc_id", "cast(quality as int) y").filter("y in (0, 1) and doc_id is not null")
        .filter(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.min("y").alias("y"))
    )
    rows = feats.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)), np.float32)
    return train(x, rows["y"].to_numpy(float))


def score(feats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Score and prediction of every row."""
    shared = feats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1)
            x = np.asarray(x.flatten()).reshape(len(x), len(FEATURES))
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return feats.select("doc_id", "x").mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, sample: int = 30_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    feats = table(featurise(docs), "gam-features")
    out = score(feats, fit(feats, labels, folds, held, sample), threshold)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, sample: int = 30_000) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that score at least the threshold, with all their columns. No shuffle of texts."""
    spark = docs.sparkSession
    known = labels.selectExpr("cast(doc_id as long) doc_id", "cast(quality as int) quality").filter("quality in (0, 1) and doc_id is not null")
    known = known.filter(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = table(docs.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "gam-sample")
    model = fit(featurise(docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")), known, folds, held, sample)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = T.text_column(batch.column(at))
            for lo, hi in T.slices(texts):
                good = shared.value.score(features(texts.slice(lo, hi - lo))) >= threshold
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(tidy(run), docs.schema)
