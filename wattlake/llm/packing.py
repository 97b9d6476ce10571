"""Sequence packing: first-fit decreasing with a tournament tree, in randomised groups.

Texts become token ids; a text's ids are cut at multiples of the sequence
length. Whole pieces are sequences of their own. The rests are dealt to groups
of about ``group`` pieces by a hash, and each group packs its rests into bins,
largest first, each into the first bin with room, which a tournament tree over
the bins' free room finds in logarithmic time.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.llm import textkit as tk
from wattlake.llm.shared import materialize

_CACHE_WORDS = 1_000_000
_state: dict = {}
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")

#: 1 for ASCII letters and digits, 2 for ASCII marks other than the apostrophe, else 0.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[39] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1


class WordEncoder:
    """Token ids of whole texts from the ids of their parts.

    The tokenizer lowers case and splits at white space, and between a letter
    or digit and any other mark (but for an apostrophe's contractions), before
    all else. So a text's ids are its parts' ids in order, and each distinct
    part is encoded once while it is cached. Chunks that hold the name of a
    special token are split at white space alone, with their case kept.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.pool, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _add(self, hashes: list[int], words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        k = len(self.index)
        self.index.update(zip(hashes, range(k, k + len(hashes)), strict=True))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's bounds in them."""
        raw, off = tk.text_bytes(col)
        starts, ends, doc = tk.word_bounds(raw, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(col) + 1, np.int64)
        data = raw.tobytes()
        whole = any(s in data for s in SPECIAL)
        if not whole:
            kind = _KIND[raw]
            cut = np.flatnonzero(kind[:-1] + kind[1:] == 3) + 1
            edge = np.zeros(len(raw) + 1, bool)
            edge[off] = True
            cut = cut[~edge[cut]]
            starts, ends = (np.sort(np.concatenate([x, cut]), kind="stable") for x in (starts, ends))
            doc = np.searchsorted(off, starts, "right") - 1
            raw = tk.LOWER[raw]
            data = raw.tobytes()
        salt = 2 if whole else 0  # the same bytes stand for other ids with their case kept
        hashes, first, inverse = np.unique(tk.span_hash(raw, starts, ends, salt), return_index=True, return_inverse=True)
        if len(self.index) > _CACHE_WORDS:
            self.clear()
        keys = hashes.tolist()
        known = self.index
        slot = np.fromiter((known.get(h, -1) for h in keys), np.int64, len(keys))
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = len(known) + np.arange(len(new))
            bounds = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self._add(hashes[new].tolist(), [data[a:b].decode() for a, b in bounds])
        slot = slot[inverse]
        begin, length = self.at[slot], self.at[slot + 1] - self.at[slot]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        return ids, total[np.searchsorted(doc, np.arange(len(col) + 1))]


def encoder(path: str) -> WordEncoder:
    if path not in _state:
        _state.clear()
        _state[path] = WordEncoder(path)
    return _state[path]


def _pieces(path: str, size: int, end_id: int):
    def fn(batches):
        enc, tail, turn = encoder(path), np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            for part in tk.chunks(batch, "text", 4 * tk.CHUNK_BYTES):
                ids, at = enc.encode(part.column("text"))
                data = ids.astype("<u4").tobytes()
                out = []
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    n = b - a + 1
                    for start in range(0, n, size):
                        stop = min(n, start + size)
                        crc = zlib.crc32(data[4 * (a + start) : 4 * (a + min(stop, n - 1))])
                        out.append((doc_id, start, stop - start, zlib.crc32(tail, crc) if stop == n else crc, n, turn))
                        turn += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "turn"])

    return fn


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length; lengths come in falling order."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    tree = [size] * (2 * leaves)  # the winner of a match is the bin with more room
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, x in enumerate(lengths.tolist()):
        k = 1
        while k < leaves:
            k = 2 * k if tree[2 * k] >= x else 2 * k + 1
        bins[i], offsets[i] = k - leaves, size - tree[k]
        tree[k] -= x
        k //= 2
        while k:
            top = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == top:
                break
            tree[k] = top
            k //= 2
    return bins, offsets


def _pack(size: int):
    def fn(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        cols = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("start", "length", "ids_crc32", "doc_tokens", "turn")}
        ids = t.column("doc_id").combine_chunks().fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        order = np.lexsort((cols["turn"], cols["ids_crc32"], cols["start"], ids, -cols["length"]))
        t = t.take(pa.array(order))
        bins, offsets = first_fit_decreasing(cols["length"][order], size)
        group = key[0].as_py()
        return pa.table({**{c: t.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}, "sequence_id": pa.array((group << 32) + bins), "offset": pa.array(offsets)})

    return fn


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, group: int = 4096) -> DataFrame:
    """Pack all texts into sequences of at most ``size`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; ``tokenizer`` is the path of a
    vocabulary file that splits at white space. Each text's ids are followed by
    ``end_id``. Returns per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Null and empty texts are one piece, the end token.
    Repeated rows are packed as often as they stand. Empty input: no rows.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, turn long"
    pieces = materialize(src.mapInArrow(_pieces(tokenizer, size, end_id), schema), "pieces")
    rests = pieces.where(F.col("length") < size)
    groups = max(1, -(-rests.count() // group))
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "turn"), F.lit(groups))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = rests.withColumn("group", key).groupBy("group").applyInArrow(_pack(size), out)
    # Whole pieces: one sequence each, numbered apart from the groups' bins by the sign.
    whole = pieces.where(F.col("length") >= size).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.union(whole)
