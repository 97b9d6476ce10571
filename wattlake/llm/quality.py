"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, learned by boosting
shallow trees in cycles over the features; the pairs of features that explain
most of what is left get tables over both features' bins in the same way. A
score is the sum of the bins' entries.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlake.llm import textkit as tk

#: Counts of byte classes, in this order.
CLASSES = ("upper", "lower", "digit", "space", "newline", "wide", "period", "exclaim", "symbol", "pipe", "other")
FEATURES = (*CLASSES, "log_bytes", "log_words", "mean_word", "long_words", "short_words", "distinct_words", "repeated_pairs", "lines", "repeated_lines", "line_words", "upper_words", "digit_words", "symbol_words", "entropy", "packed")

_CLASS = np.full(256, CLASSES.index("other"), np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 13, 32]], _CLASS[10], _CLASS[128:], _CLASS[46], _CLASS[33] = 3, 4, 5, 6, 7
for _c in b"#$%&*@^~<>{}[]\\=+_`":
    _CLASS[_c] = 8
_CLASS[124] = 9


def features(col: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, over its whole length."""
    raw, off = tk.text_bytes(col)
    n = len(col)
    out = np.zeros((n, len(FEATURES)))
    starts, ends, doc = tk.word_bounds(raw, off)
    kind = _CLASS[raw]
    word = tk.span_hash(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    pair, pair_doc, _ = tk.shingles(word, doc, 2)
    size = ends - starts
    totals = {}
    for name, cls in (("u", 0), ("d", 2), ("s", 8)):
        s = np.concatenate([[0], np.cumsum(kind == cls)])
        totals[name] = s[ends] - s[starts]
    line = np.zeros(256, bool)
    line[10] = True
    l0, l1, ldoc = tk.word_bounds(raw, off, ~line[raw])
    lines = tk.span_hash(raw, l0, l1) if len(l0) else np.zeros(0, np.uint64)
    w, p, ln = (np.searchsorted(d, np.arange(n + 1)) for d in (doc, pair_doc, ldoc))
    data = raw.tobytes()
    for i in range(n):
        a, b = off[i], off[i + 1]
        size_i = b - a
        if size_i == 0:
            continue
        share = np.bincount(kind[a:b], minlength=len(CLASSES)) / size_i
        hist = np.bincount(raw[a:b], minlength=256)
        hist = hist[hist > 0] / size_i
        s, nw, nl = slice(w[i], w[i + 1]), w[i + 1] - w[i], ln[i + 1] - ln[i]
        np_ = p[i + 1] - p[i]
        lengths = size[s]
        d = max(1, nw)
        out[i] = (
            *share, np.log1p(size_i), np.log1p(nw), lengths.mean() if nw else 0, (lengths > 12).sum() / d, (lengths <= 3).sum() / d,
            len(tk.distinct(word[s])) / d, 1 - len(tk.distinct(pair[p[i] : p[i + 1]])) / max(1, np_), np.log1p(nl),
            1 - len(tk.distinct(lines[ln[i] : ln[i + 1]])) / max(1, nl), nw / max(1, nl), (totals["u"][s] >= 2).sum() / d, (totals["d"][s] > 0).sum() / d,
            (totals["s"][s] > 0).sum() / d, -(hist * np.log2(hist)).sum(), len(zlib.compress(data[a:b], 1)) / size_i,
        )
    return out


@dataclass
class AdditiveModel:
    """Bin edges and tables per feature, pairs of features and their coarser edges and tables."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], "right")]
        for (i, j), g in zip(self.pairs, self.grids, strict=True):
            total += g[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float, least: float) -> np.ndarray:
    """A table over bins from a tree of at most ``leaves`` leaves, grown where the gain is largest."""
    cuts = [0, len(g)]
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            m = np.arange(a + 1, b)
            if not len(m):
                continue
            gl, hl, gr, hr = gs[m] - gs[a], hs[m] - hs[a], gs[b] - gs[m], hs[b] - hs[m]
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + l2)
            gain[(hl < least) | (hr < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], int(m[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = -(gs[b] - gs[a]) / (hs[b] - hs[a] + l2)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, np.ndarray]:
    """The best four-leaf table over a grid: one cut of the first feature, one of the second on either side."""
    def halves(a, b):
        cg, ch = np.cumsum(a.sum(0)), np.cumsum(b.sum(0))
        gl, hl, gr, hr = cg[:-1], ch[:-1], cg[-1] - cg[:-1], ch[-1] - ch[:-1]
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2), -1.0)
        k = int(gain.argmax()) if len(gain) else -1
        whole = cg[-1] ** 2 / (ch[-1] + l2)
        if k < 0 or gain[k] <= whole:
            return whole, np.full(a.shape[1], -cg[-1] / (ch[-1] + l2))
        row = np.empty(a.shape[1])
        row[: k + 1], row[k + 1 :] = -gl[k] / (hl[k] + l2), -gr[k] / (hr[k] + l2)
        return gain[k], row

    best, table = -1.0, np.zeros_like(g)
    for m in range(1, len(g)):
        (a, top), (b, low) = halves(g[:m], h[:m]), halves(g[m:], h[m:])
        if a + b > best:
            best, table = a + b, np.concatenate([np.tile(top, (m, 1)), np.tile(low, (len(g) - m, 1))])
    return best - g.sum() ** 2 / (h.sum() + l2), table


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, cycles: int = 250, rate: float = 0.08, leaves: int = 3, pairs: int = 8, coarse: int = 10, l2: float = 2.0, least: float = 3.0) -> AdditiveModel:
    """Boost all features in turn, cycle after cycle, then the strongest pairs. Stops where a tenth kept apart no longer gains."""
    model = AdditiveModel()
    if len(y) == 0 or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        model.intercept = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
        return model
    n, d = x.shape
    apart = np.arange(n) % 10 == 9
    model.intercept = float(np.log(y.mean() / (1 - y.mean())))
    model.edges = [_edges(x[:, j], bins) for j in range(d)]
    model.coarse = [_edges(x[:, j], coarse) for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    f = np.full(n, model.intercept)
    w = (~apart).astype(float)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return (p - y) * w, p * (1 - p) * w

    def loss() -> float:
        z = np.where(y > 0, f, -f)[apart]
        return float(np.logaddexp(0, -z).mean())

    def boost(step, tables) -> None:
        nonlocal f
        best, kept, stale = loss(), [t.copy() for t in tables], 0
        start = f.copy()
        top = start
        for _ in range(cycles):
            step()
            now = loss()
            if now < best - 1e-5:
                best, kept, stale, top = now, [t.copy() for t in tables], 0, f.copy()
            else:
                stale += 1
                if stale >= 20:
                    break
        for t, k in zip(tables, kept, strict=True):
            t[...] = k
        f = top

    def single() -> None:
        for j in range(d):
            if len(model.tables[j]) > 1:
                g, h = slopes()
                k = len(model.tables[j])
                t = rate * _tree(np.bincount(at[j], g, k), np.bincount(at[j], h, k), leaves, l2, least)
                model.tables[j] += t
                f[:] = f + t[at[j]]

    boost(single, model.tables)
    g, h = slopes()
    grid = lambda i, j, v: np.bincount(rough[i] * (len(model.coarse[j]) + 1) + rough[j], v, (len(model.coarse[i]) + 1) * (len(model.coarse[j]) + 1)).reshape(len(model.coarse[i]) + 1, -1)
    gains = sorted(((_grid_tree(grid(i, j, g), grid(i, j, h), l2, least)[0], i, j) for i in range(d) for j in range(i + 1, d) if len(model.coarse[i]) and len(model.coarse[j])), reverse=True)
    model.pairs = [(i, j) for _, i, j in gains[:pairs]]
    model.grids = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]

    def double() -> None:
        for (i, j), table in zip(model.pairs, model.grids, strict=True):
            g, h = slopes()
            t = rate * _grid_tree(grid(i, j, g), grid(i, j, h), l2, least)[1]
            table += t
            f[:] = f + t[rough[i], rough[j]]

    boost(double, model.grids)
    return model


def _labelled(batches):
    for batch in batches:
        for part in tk.chunks(batch, "text"):
            x = features(part.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), flat], ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000) -> AdditiveModel:
    """Learn ``quality`` (0 or 1) of ``labels`` from the texts of ``docs``.

    Labels with a null id or quality take no part; of repeated ids the mean
    decides (half or more is 1). At most about ``fit_rows`` labels, drawn by a
    hash of doc_id, are used; of a doc_id that stands in several rows the
    smallest text counts, once. Without labels, as with empty tables, or with
    one class only, the model is its base rate.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    marks = marks.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    total = marks.count()
    drawn = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, fit_rows / max(1, total)))).limit(2 * fit_rows)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = src.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = one.mapInArrow(_labelled, "doc_id long, quality int, x array<double>").toArrow().sort_by("doc_id")
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, got.column("quality").to_numpy().astype(float))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """All rows and columns of ``docs`` with quality_score of ``text``; null and empty texts have all features 0.

    Every row is scored by itself, whole, however long; repeated ones alike. A
    column of the input named quality_score is replaced; no rows give none.
    """
    src = docs.drop("quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: features by bins

    def fn(batches):
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.predict(features(part.column("text"))))], [*part.schema.names, "quality_score"])

    return src.mapInArrow(fn, T.StructType([*src.schema.fields, T.StructField("quality_score", T.DoubleType())]))


__all__ = ["AdditiveModel", "FEATURES", "features", "fit", "score", "train"]
