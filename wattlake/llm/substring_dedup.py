"""Substring deduplication by content-defined chunking.

A gear hash rolls over a text's bytes; where its high bits are zero, a chunk
ends at the next white space. Bounds depend on the last 32 bytes alone, so an
insertion shifts no bound beyond its own chunk. Chunks are compared by a
96-bit digest; of equal chunks the first (smallest doc_id, then position)
stays. Runs of repeated chunks of ``min_words`` words or more are cut out.
A chunk travels as digest, document and place (its number in the text and its
words); only texts with a run to cut are chunked again, to find its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlake.llm import textkit as tk
from wattlake.llm.shared import Scratch

#: A fixed gear table by rule: mixed byte values.
GEAR = (tk.mix(np.arange(256, dtype=np.uint64) + np.uint64(0x5EED)) >> np.uint64(32)).astype(np.uint32)
WINDOW_STEPS = (1, 2, 4, 8, 16)


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + GEAR[byte] modulo 2**32 at every byte, by doubling windows."""
    h = GEAR[raw]
    for s in WINDOW_STEPS:
        if len(h) > s:
            h[s:] += h[:-s] << np.uint32(s)
    return h


def chunk_bounds(raw: np.ndarray, off: np.ndarray, bits: int, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the chunks of all texts; they tile every text."""
    gap = np.flatnonzero(tk.SPACE[raw])
    hit = np.flatnonzero(gear_hash(raw) >> np.uint32(32 - bits) == 0)
    # The window must lie within the text, else the text before it would move bounds.
    text = np.searchsorted(off, hit, "right") - 1
    some = hit - off[text] >= 31
    hit, text = hit[some], text[some]
    at = np.searchsorted(gap, hit)
    some = at < len(gap)
    # The white space must lie within the text as well, else the last word would move the next text's bounds.
    some[some] = gap[at[some]] < off[text[some] + 1]
    cut = gap[tk.distinct(at[some])] + 1
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    cut = cut[~edge[cut]]
    doc = np.searchsorted(off, cut, "right") - 1
    # A bound too close to the one before it is none; decided by successive bounds, not by position.
    before = np.maximum(np.append([0], cut[:-1]), off[doc]) if len(cut) else cut
    cut = cut[cut - before >= min_bytes]
    full = np.flatnonzero(np.diff(off) > 0)
    starts = np.sort(np.concatenate([cut, off[full]]), kind="stable")
    ends = np.append(starts[1:], off[-1])
    return starts, ends, np.searchsorted(off, starts, "right") - 1


_ROW = "h1 long, h2 int, doc_id long, place long"
_NAMES = ["h1", "h2", "doc_id", "place"]
#: A place is the chunk's number in its text times WORDS plus its words, at most WORDS - 1; TOLD marks it as repeated already.
WORDS = 1 << 16
TOLD = 1 << 62
#: Chunks that a task holds before it sends their first occurrences on.
HELD = 1_500_000


def _tiles(raw: np.ndarray, off: np.ndarray, bits: int, min_bytes: int) -> tuple[np.ndarray, ...]:
    """Starts, ends, text numbers, places, first and last words' bounds of all chunks with a word."""
    starts, ends, doc = chunk_bounds(raw, off, bits, min_bytes)
    w0, w1, _ = tk.word_bounds(raw, off)
    a, b = np.searchsorted(w0, starts), np.searchsorted(w0, ends)
    some = b > a
    starts, ends, doc, a, b = (x[some] for x in (starts, ends, doc, a, b))
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return starts, ends, doc, number * WORDS + np.minimum(b - a, WORDS - 1), w0[a] if len(a) else a, w1[b - 1] if len(b) else b


def _first(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each row stands where its digest's first row does (rows come sorted)."""
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc == doc[head]) & (place == place[head])


def _chunks(bits: int, min_bytes: int):
    """Chunks of all texts. Within a task, all but a digest's first occurrence are told as repeated already, so a hot chunk leaves a task once."""

    def send(held):
        h1, h2, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, doc, h2, h1))
        h1, h2, doc, place = (x[order] for x in (h1, h2, doc, place))
        told = ~_first(h1, h2, doc, place)
        # What is told needs no digest any more; any key will do to spread it.
        h1[told] = tk.mix(np.flatnonzero(told).astype(np.uint64)).view(np.int64)
        h2[told] = 0
        place[told] |= TOLD
        for i in range(0, len(h1), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[j]) for x in (h1, h2, doc, place)], _NAMES)

    def fn(batches):
        held, size = [], 0
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                raw, off = tk.text_bytes(part.column("text"))
                ids = part.column("doc_id").to_numpy()
                # Leading and trailing white space is no part of the digest: a chunk equals its copy at a text's end.
                starts, _, doc, place, s, e = _tiles(raw, off, bits, min_bytes)
                if not len(starts):
                    continue
                h1, h2 = (tk.span_hash(raw, s, e, salt) for salt in (0, 1))
                held.append((h1.view(np.int64), h2.astype(np.uint32).view(np.int32), ids[doc], place))
                size += len(starts)
                if size > HELD:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    return fn


def _repeated(batches):
    """Of rows sorted by digest and place, all but each digest's first, and what was told before."""
    head = None  # digest and place of the last digest's first row
    for batch in batches:
        if not batch.num_rows:
            continue
        got = tuple(batch.column(c).to_numpy() for c in _NAMES)
        told = got[3] >= TOLD
        if head is not None:
            got = tuple(np.concatenate([[x], y]) for x, y in zip(head, got, strict=True))
        first = _first(*got)
        at = int(np.flatnonzero((got[0] == got[0][-1]) & (got[1] == got[1][-1]))[0])
        keep = told | ~first[len(first) - len(told) :]
        head = tuple(x[at] for x in got)
        yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_id").to_numpy()[keep]), pa.array(batch.column("place").to_numpy()[keep] & (TOLD - 1))], ["doc_id", "place"])


def _runs(places: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """First and last chunk and the words of every run of successive chunks with ``min_words`` words or more."""
    places = np.unique(places)
    number, words = places // WORDS, places % WORDS
    cut = np.flatnonzero(np.diff(number) != 1) + 1
    return [(int(n[0]), int(n[-1]), int(w.sum())) for n, w in zip(np.split(number, cut), np.split(words, cut), strict=True) if len(n) and w.sum() >= min_words]


def _passages(min_words: int):
    """Documents with a passage to cut, and its runs of chunks."""

    def fn(batches):
        kind = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32()), ("words", pa.int32())]))
        for batch in batches:
            runs = [_runs(p.values.to_numpy(zero_copy_only=False), min_words) for p in batch.column("places")]
            some = [i for i, r in enumerate(runs) if r]
            spans = [[{"a": a, "z": z, "words": w} for a, z, w in runs[i]] for i in some]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some, pa.int64())), pa.array(spans, kind)], ["doc_id", "runs"])

    return fn


def _cut(bits: int, min_bytes: int):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def fn(batches):
        for batch in batches:
            for part in tk.chunks(batch, "text"):
                runs, text = part.column("runs").to_pylist(), part.column("text").to_pylist()
                removed, kept = [0] * len(text), [[] for _ in text]
                marked = [i for i, r in enumerate(runs) if r]
                raw, off = tk.text_bytes(part.column("text").take(pa.array(marked, pa.int64())))
                starts, ends, doc, *_ = _tiles(raw, off, bits, min_bytes)
                base = np.searchsorted(doc, np.arange(len(marked)))
                for k, i in enumerate(marked):
                    pieces, last = [], off[k]
                    for r in runs[i]:
                        a, z = starts[base[k] + r["a"]], ends[base[k] + r["z"]]
                        pieces.append(raw[last:a].tobytes())
                        kept[i].append({"start": int(a - off[k]), "end": int(z - off[k])})
                        removed[i] += r["words"]
                        last = z
                    text[i] = b"".join([*pieces, raw[last : off[k + 1]].tobytes()]).decode()
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(text, pa.string()), pa.array(removed, pa.int32()), pa.array(kept, span)], ["row", "text", "words_removed", "spans_removed"])

    return fn


def substring_dedup(docs: DataFrame, min_words: int = 20, bits: int = 4, min_bytes: int = 8) -> DataFrame:
    """Cut passages out of texts that stand elsewhere before.

    ``docs`` needs ``doc_id`` (long) and ``text``. Returns one row per input row
    with all its columns, the text without the passages, words_removed and
    spans_removed (byte spans of the UTF-8 text); input columns of these two
    names are replaced. A chunk has about ``2 ** bits + min_bytes`` bytes; a
    repeated passage loses all chunks that lie wholly in it.

    Null and empty texts come back as they are, and so do rows without doc_id
    and rows whose doc_id stands with different texts: neither takes part. Rows
    that repeat a doc_id and its text count as one and are cut alike. A line
    written many times, within a text or across texts, keeps its first
    occurrence. Texts of any length are chunked whole; white space alone is no
    chunk. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "words_removed", "spans_removed")]
    src = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    known = src.where("d is not null and text is not null").select(F.col("d").alias("doc_id"), "text")
    h = F.xxhash64("text")
    torn = scratch.write(known.groupBy("doc_id").agg(F.min(h).alias("a"), F.max(h).alias("z")).where("a <> z").select("doc_id"), "torn")
    if not torn.isEmpty():
        known = known.join(torn, "doc_id", "left_anti")
    chunks = known.mapInArrow(_chunks(bits, min_bytes), _ROW).repartition("h1", "h2").sortWithinPartitions(*_NAMES)
    again = chunks.mapInArrow(_repeated, "doc_id long, place long")
    passages = again.groupBy("doc_id").agg(F.collect_list("place").alias("places")).where(F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x % WORDS) >= min_words)
    runs = scratch.write(passages.mapInArrow(_passages(min_words), "doc_id long, runs array<struct<a:int,z:int,words:int>>"), "runs")
    scratch.drop("torn")
    joined = src.join(runs.hint("merge"), F.col("d") == F.col("doc_id"), "left").select("row", "text", "runs")
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("words_removed", T.IntegerType()), *T._parse_datatype_string("spans_removed array<struct<start:int,end:int>>").fields])
    cut = joined.mapInArrow(_cut(bits, min_bytes), schema)
    names = [f"row.`{c}`" if c in others else "text" for c in docs.columns if c not in ("words_removed", "spans_removed")]
    return cut.select(*names, "words_removed", "spans_removed")
