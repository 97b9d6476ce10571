"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Seeds are word n-grams of the test items. One pass over the corpus finds every
place where a seed stands. All of an item's seeds join it to passages; two seeds
near one diagonal make a candidate, whose window is aligned with the item word
by word. The score is the alignment's share of a
perfect one, so edited copies score by how much of the item they keep.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattlake.llm import textkit as tk
from wattlake.llm.shared import Scratch

MATCH, MISMATCH, GAP = 2.0, -1.0, 1.0
#: Up to so many distinct seeds (8 bytes each) go to the tasks; beyond, seeds meet in a shuffled join.
SEEDS_IN_MEMORY = 2_000_000


def _item_words(n: int):
    def fn(batches):
        for batch in batches:
            words, doc, _, _ = tk.normal_words(batch.column("text"))
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(words.view(np.int64)))], ["item_id", "words"])

    return fn


def _seeds(n: int):
    def fn(batches):
        for batch in batches:
            words = batch.column("words")
            words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
            ids = batch.column("item_id").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(ids)), words.value_lengths().to_numpy(zero_copy_only=False))
            h, d, at = tk.shingles(words.flatten().to_numpy(zero_copy_only=False).view(np.uint64), doc, n)
            start = np.searchsorted(doc, np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[d], pa.int64()), pa.array(h.view(np.int64)), pa.array((at - start[d]).astype(np.int32))], ["item_id", "seed", "item_pos"])

    return fn


def _hits(n: int, known):
    """Places of seeds in texts; ``known`` broadcasts the sorted seeds, or is None for all n-grams."""

    def fn(batches):
        seeds = known.value if known is not None else None
        if seeds is not None:
            sieve = np.zeros(1 << 22, bool)
            sieve[seeds >> np.uint64(42)] = True
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                words, doc, _, _ = tk.normal_words(part.column("text"))
                h, d, at = tk.shingles(words, doc, n)
                if seeds is not None:
                    some = np.flatnonzero(sieve[h >> np.uint64(42)])
                    i = np.minimum(np.searchsorted(seeds, h[some]), max(0, len(seeds) - 1))
                    some = some[seeds[i] == h[some]] if len(seeds) else some[:0]
                    h, d, at = h[some], d[some], at[some]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                start = np.searchsorted(doc, np.arange(part.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(ids[d], pa.int64()), pa.array(h.view(np.int64)), pa.array((at - start[d]).astype(np.int32))], ["doc_id", "seed", "doc_pos"])

    return fn


def smith_waterman(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores and their last window positions, for pairs of padded rows.

    Item padding is 0, window padding 1; neither equals a word's hash but by
    chance of 2**-64. Gaps cost ``GAP`` a word, so the row recursion is a
    running maximum.
    """
    b, w = windows.shape
    slope = GAP * np.arange(1, w + 1, dtype=np.float32)
    row = np.zeros((b, w + 1), np.float32)
    best, end = np.zeros(b, np.float32), np.zeros(b, np.int64)
    for i in range(items.shape[1]):
        word = items[:, i : i + 1]
        step = np.where(word == 0, np.float32(-1e6), np.where(windows == word, np.float32(MATCH), np.float32(MISMATCH)))
        e = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] - np.float32(GAP)), 0)
        e = np.maximum.accumulate(e + slope, axis=1) - slope
        row[:, 1:] = np.where(word == 0, row[:, 1:], e)
        at = row[:, 1:].argmax(1)
        top = row[np.arange(b), at + 1]
        up = top > best
        best[up], end[up] = top[up], at[up]
    return best, end


def _align(slack: float, threshold: float):
    def fn(batches):
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                words, doc, _, _ = tk.normal_words(part.column("text"))
                start = np.searchsorted(doc, np.arange(part.num_rows + 1))
                ids, jobs = part.column("doc_id").to_pylist(), []
                for r, cands in enumerate(part.column("cands").to_pylist()):
                    own = words[start[r] : start[r + 1]]
                    for c in cands:
                        item = np.array(c["words"], np.int64).view(np.uint64)
                        room = int(slack * len(item)) + 4
                        diags = sorted(c["diags"])
                        lo = 0
                        for k in range(1, len(diags) + 1):  # clusters of near diagonals
                            if k == len(diags) or diags[k] - diags[k - 1] > room:
                                if k - lo >= min(2, c["seeds"]):
                                    a, z = max(0, diags[lo] - room), min(len(own), diags[k - 1] + len(item) + room)
                                    jobs.append((ids[r], c["item_id"], item, own[a:z], a))
                                lo = k
                jobs.sort(key=lambda j: (len(j[2]), len(j[3])))
                out = []
                i = 0
                while i < len(jobs):
                    k = i
                    while k < len(jobs) and (k == i or (k - i + 1) * len(jobs[k][3]) <= 400_000):
                        k += 1
                    some = jobs[i:k]
                    a = np.zeros((len(some), max(len(j[2]) for j in some)), np.uint64)
                    b = np.ones((len(some), max(len(j[3]) for j in some)), np.uint64)
                    for y, j in enumerate(some):
                        a[y, : len(j[2])], b[y, : len(j[3])] = j[2], j[3]
                    best, end = smith_waterman(a, b)
                    for j, s, e in zip(some, best, end, strict=True):
                        score = float(s) / (MATCH * len(j[2]))
                        if score >= threshold:
                            out.append((j[0], j[1], score, j[4] + int(e)))
                    i = k
                cols = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], ["doc_id", "item_id", "score", "last_word"])

    return fn


def _phrases(batches):
    """Short items' words as one hash each: item_id, size, phrase."""
    for batch in batches:
        words = [w.values.to_numpy(zero_copy_only=False).view(np.uint64) for w in batch.column("words")]
        hashes = [int(_phrase(w, len(w)).view(np.int64)[0]) for w in words]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([len(w) for w in words], pa.int32()), pa.array(hashes, pa.int64())], ["item_id", "size", "phrase"])


def _phrase(words: np.ndarray, n: int) -> np.ndarray:
    return tk.shingles(words, np.zeros(len(words), np.int64), n)[0] if n > 1 else words


def _copies(known):
    """Places of short items' whole phrases: doc_id, phrase, size, last_word. ``known`` broadcasts sorted phrases by size."""

    def fn(batches):
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                words, doc, _, _ = tk.normal_words(part.column("text"))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                start = np.searchsorted(doc, np.arange(part.num_rows))
                for n, phrases in known.value.items():
                    h, d, at = tk.shingles(words, doc, n) if n > 1 else (words, doc, np.arange(len(words)))
                    i = np.minimum(np.searchsorted(phrases, h), len(phrases) - 1)
                    some = np.flatnonzero(phrases[i] == h)
                    # A document's first place of a phrase tells all there is to tell.
                    _, first = np.unique(np.stack([d[some].astype(np.uint64), h[some]], 1), axis=0, return_index=True)
                    some = some[first]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[d[some]], pa.int64()), pa.array(h[some].view(np.int64)), pa.array(np.full(len(some), n, np.int32)), pa.array((at[some] + n - 1 - start[d[some]]).astype(np.int32))], ["doc_id", "phrase", "size", "last_word"])

    return fn


def _exact(src: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Whole copies of items too short to align: exact phrases, found wherever they stand in a text.

    There are fewer sizes than ``min_item_words``; phrases go to the tasks, as
    distinct items of so few words are bounded by their written table's size.
    """
    phrases = scratch.write(items.mapInArrow(_phrases, "item_id long, size int, phrase long"), "phrases")
    by_size: dict[int, list[int]] = {}
    for r in phrases.select("size", "phrase").distinct().limit(SEEDS_IN_MEMORY + 1).toLocalIterator():
        by_size.setdefault(r["size"], []).append(r["phrase"])
    if not by_size:
        return None
    if sum(map(len, by_size.values())) > SEEDS_IN_MEMORY:
        raise ValueError(f"more than {SEEDS_IN_MEMORY} short items")
    known = src.sparkSession.sparkContext.broadcast({n: np.sort(np.array(p, np.int64).view(np.uint64)) for n, p in by_size.items()})
    found = src.mapInArrow(_copies(known), "doc_id long, phrase long, size int, last_word int")
    return found.join(F.broadcast(phrases), ["phrase", "size"]).select("doc_id", "item_id", F.lit(1.0).alias("score"), "last_word")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, slack: float = 0.3, min_item_words: int = 5, seeds_in_memory: int = SEEDS_IN_MEMORY, scratch: Scratch | None = None) -> DataFrame:
    """Test items found in documents: doc_id, item_id, score (1 for a whole copy), last_word.

    One row per document and item whose best alignment reaches ``threshold``;
    last_word is the index of the document's word where it ends (of equal scores
    the last one). Words are lower-cased runs of letters, marks and digits. Items
    under ``min_item_words`` words are too short to tell an edit from chance:
    they are found as whole phrases, with score 1; items without a word, null
    texts and null ids take no part. Repeated documents or items keep their
    rows' one best score; rows of a repeated id count as one document. Texts of
    any length are searched whole, item by item. Empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    worded = scratch.write(items.mapInArrow(_item_words(n), "item_id long, words array<long>").where(F.size("words") > 0), "worded")
    short = max(n, min_item_words)
    items = worded.where(F.size("words") >= short)
    exact = _exact(src, worded.where(F.size("words") < short), scratch)
    seeds = scratch.write(items.mapInArrow(_seeds(n), "item_id long, seed long, item_pos int"), "seeds")
    known = None
    distinct = seeds.select("seed").distinct()
    if seeds.count() <= seeds_in_memory:
        known = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in distinct.collect()], np.int64).view(np.uint64)))
    hits = src.mapInArrow(_hits(n, known), "doc_id long, seed long, doc_pos int")
    hits = scratch.write(hits if known is not None else hits.join(distinct, "seed").select("doc_id", "seed", "doc_pos"), "hits")
    # Every seed joins: those that an edited copy keeps are no rarer than those that only an exact one has.
    occur = seeds.join(hits.select("seed").distinct(), "seed").withColumn("seeds", F.count("*").over(Window.partitionBy("item_id")))
    occur = scratch.write(occur.select("item_id", "seed", "item_pos", "seeds"), "occurring")
    pairs = hits.join(occur, "seed").groupBy("doc_id", "item_id").agg(F.collect_list(F.expr("doc_pos - item_pos")).alias("diags"), F.max("seeds").alias("seeds"))
    cands = pairs.where(F.size("diags") >= F.least(F.lit(2), "seeds")).join(items, "item_id")
    per_doc = scratch.write(cands.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diags", "seeds", "words")).alias("cands")), "candidates")
    # Candidates grow with the corpus: one plan at every size, never a broadcast that turns into a shuffle.
    found = src.join(per_doc.hint("merge"), "doc_id").select("doc_id", "text", "cands").mapInArrow(_align(slack, threshold), "doc_id long, item_id long, score double, last_word int")
    if exact is not None:
        found = found.union(exact)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "last_word")).alias("m")).select("doc_id", "item_id", "m.score", "m.last_word")
