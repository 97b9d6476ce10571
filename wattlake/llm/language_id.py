"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Letters of a text (lower case, anything else a space) give hashed 1- to 3-grams.
Document frequencies come from all training texts. The weights are learned by
follow-the-regularised-leader with elastic-net penalties, which leaves most of
them zero, and a temperature fitted on rows kept out of training calibrates the
probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlake.llm import textkit as tk

BITS = 16
MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_counts(texts: list[str | None]):
    """Yield per text its hashed n-grams' distinct numbers and counts; none without a letter."""
    s = "\0".join((t or "").replace("\0", " ").lower() for t in texts) + "\0"
    x = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = x == 0
    x = np.where(letters()[x] | stop, x, np.uint32(32))
    gap = x == 32
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    keep[0] = True
    x = x[keep]
    ends = np.flatnonzero(x == 0)
    a, b, c = (x * m for m in MULTIPLIERS)
    g1, g2 = a.copy(), np.zeros_like(a)
    g2[:-1] = a[:-1] + b[1:]
    g3 = np.zeros_like(a)
    g3[:-2] = a[:-2] + b[1:-1] + c[2:]
    g1, g2, g3 = (((g ^ (g >> np.uint32(15))) * MULTIPLIERS[1]) >> np.uint32(32 - BITS) for g in (g1, g2 + np.uint32(1), g3 + np.uint32(2)))
    first = 0
    for end in ends.tolist():
        n = end - first
        if n > 1 or n == 1 and x[first] != 32:
            grams = np.concatenate([g1[first:end], g2[first : end - 1], g3[first : max(first, end - 2)]])
            count = np.bincount(grams, minlength=1 << BITS)
            at = np.flatnonzero(count)
            yield at, count[at]
        else:
            yield None, None
        first = end + 1


def _idf_counts(batches):
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for part in tk.chunks(batch, "text"):
            for at, _ in gram_counts(part.column("text").to_pylist()):
                if at is not None:
                    df[at] += 1
                    n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], n), pa.int64())], ["gram", "n"])


def _features(batches):
    for batch in batches:
        for part in tk.chunks(batch, "text"):
            rows = [(lang, at, c) for lang, (at, c) in zip(part.column("lang").to_pylist(), gram_counts(part.column("text").to_pylist()), strict=True) if at is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32()))], ["lang", "grams", "counts"])


@dataclass
class LanguageModel:
    """Learned languages, idf per gram, weights (grams by languages, mostly zero), bias, temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        v = np.log1p(count) * self.idf[at]
        return v / np.sqrt(v @ v)

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.vector(at, count) @ self.weights[at] + self.bias

    def predict(self, at, count) -> tuple[str, float]:
        if at is None or not self.langs:
            return "und", 0.0
        p = softmax(self.logits(at, count) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(model: LanguageModel, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> None:
    """Follow-the-regularised-leader, proximal, one row at a time; weights are solved where a row needs them."""
    k, d = len(model.langs), len(model.idf)
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))  # the last row is the bias, without penalty on it

    def solve(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            y, at, v = rows[i]
            at, v = np.append(at, d), np.append(v, 1.0)
            za, na = z[at], n[at]
            w = solve(za, na, l1)
            g = softmax(v @ w)
            g[y] -= 1
            grad = v[:, None] * g
            z[at] += grad - (np.sqrt(na + grad * grad) - np.sqrt(na)) / alpha * w
            n[at] += grad * grad
    w = solve(z, n, l1)
    model.weights, model.bias = w[:d].astype(np.float32), solve(z[d], n[d], 0.0)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section on its logarithm."""
    def loss(t: float) -> float:
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()

    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, fit_rows: int = 6000, most_langs: int = 400, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of all rows whose lang is not null.

    Document frequencies cover all of them. The weights are fitted on about
    ``fit_rows`` distinct texts, an equal share of each language, chosen by a
    hash of the text, so copies and repeated rows come to the driver once; a
    fifth of these fits the temperature. More than ``most_langs`` languages are
    an error: the weights, one per gram and language, would not fit. No usable
    row, as in an empty table: a model without languages, which predicts ``und``
    throughout.
    """
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).limit(most_langs + 1).collect()}
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    langs, d = sorted(counts), 1 << BITS
    model = LanguageModel(langs, np.ones(d, np.float32), np.zeros((d, len(langs)), np.float32), np.zeros(len(langs)), 1.0)
    if not langs:
        return model
    df = {r["gram"]: r["n"] for r in known.select("text").mapInArrow(_idf_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(-1, 0)
    seen = np.zeros(d)
    seen[list(df)] = list(df.values())
    model.idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    share = max(20, fit_rows // len(langs))
    draw = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, share / counts[lang])))])[F.col("lang")]
    one = known.where(draw < rate).groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")).select("lang", "text")
    got = one.mapInArrow(_features, "lang string, grams array<int>, counts array<int>").toArrow()
    index = {lang: i for i, lang in enumerate(langs)}
    rows = []
    for lang, at, c in zip(got.column("lang").to_pylist(), got.column("grams"), got.column("counts"), strict=True):
        at, c = at.values.to_numpy(zero_copy_only=False), c.values.to_numpy(zero_copy_only=False)
        rows.append((index[lang], at, model.vector(at, c), c))
    rows.sort(key=lambda r: (r[0], len(r[1]), int(r[1].sum()), int(r[3].sum())))  # one order whatever the tasks' order
    apart, fit = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    fit_ftrl(model, [(r[0], r[1], r[2]) for r in (fit or rows)], epochs, alpha, beta, l1, l2)
    if len(apart) > 1:
        model.temperature = fit_temperature(np.stack([model.logits(r[1], r[3]) for r in apart]), np.array([r[0] for r in apart]))
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and lang_score of ``text``.

    Null texts, empty ones and those without a letter are ``und`` with score 0;
    of languages that tie the first by name counts. Every row is told by itself,
    whole, however long; repeated ones alike; an empty table gives no rows.
    Columns of the input named as the two new ones are replaced.
    """
    src = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: grams by languages

    def fn(batches):
        m = shared.value
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                got = [m.predict(at, c) for at, c in gram_counts(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*part.schema.names, "lang_pred", "lang_score"])

    return src.mapInArrow(fn, T.StructType([*src.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


__all__ = ["LanguageModel", "fit_ftrl", "fit_temperature", "fold_of", "gram_counts", "identify", "train"]
