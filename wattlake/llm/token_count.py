"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A word starts as one symbol a byte. A heap holds the ranks of its adjacent
pairs; the lowest is popped, merged in a linked list of the symbols, and the two
new pairs are pushed. A word has as many tokens as it had symbols, less the
merges. Distinct words are counted once while a worker remembers them, and a
text's count is the sum over its words.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.llm import textkit as tk

_CACHE_WORDS = 1_000_000
_state: dict = {}

#: 1 for ASCII letters and digits, 2 for ASCII marks other than the apostrophe, else 0.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[39] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1

#: The steps of a vocabulary that lowers case, drops white space and keeps letters, digits and marks apart.
PARTED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def merge_count(symbols: list[int], ranks: dict[int, int], made: list[int], shift: int) -> int:
    """Merges of a word of these symbols: the adjacent pair of the lowest rank, the leftmost of equals, until none is left.

    ``ranks`` has the rank of a pair (left << shift | right), ``made`` the symbol that the merge of each rank gives.
    """
    n = len(symbols)
    if n < 2:
        return 0
    sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = [r * n + i for i in range(n - 1) if (r := get(sym[i] << shift | sym[i + 1])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = divmod(heapq.heappop(heap), n)
        j = after[i]
        if sym[i] < 0 or j >= n or get(sym[i] << shift | sym[j]) != rank:
            continue  # one of the two has been merged since
        merges += 1
        sym[i], sym[j], k = made[rank], -1, after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if (r := get(sym[i] << shift | sym[k])) is not None:
                heapq.heappush(heap, r * n + i)
        if (h := before[i]) >= 0 and (r := get(sym[h] << shift | sym[i])) is not None:
            heapq.heappush(heap, r * n + h)
    return merges


class TokenCounter:
    """Counts of whole texts by a byte-pair vocabulary file of the tokenizers library.

    The file's own normalizer and pre-tokenizer give the words; strings of its
    added tokens, found in the text as it is, count one each.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: a plain byte-pair vocabulary is needed")
        added = spec["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: added tokens that are not found as they stand")
        self.special = [t["content"] for t in sorted(added, key=lambda t: -len(t["content"]))]
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab = vocab = model["vocab"]
        self.shift = max(vocab.values()).bit_length()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = [vocab[a + b] for a, b in pairs]
        self.ranks: dict[int, int] = {}
        for r, (a, b) in enumerate(pairs):
            self.ranks[vocab[a] << self.shift | vocab[b]] = r
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.parted = spec["normalizer"] == PARTED["normalizer"] and steps[0].get("pattern") == {"Regex": PARTED["split"]} and self.end != ""
        self.words: dict[str, int] = {}
        self.parts: dict[int, int] = {}

    def word(self, w: str) -> int:
        """Tokens of one word, its bytes written as the vocabulary writes them."""
        n = self.words.get(w)
        if n is None:
            try:
                symbols = [self.vocab[c] for c in w[:-1]] + [self.vocab[w[-1] + self.end]]
            except KeyError:  # a byte that the vocabulary lacks gives no token, and parts what stands beside it
                symbols = [self.vocab.get(c, -1) for c in w[:-1]] + [self.vocab.get(w[-1] + self.end, -1)]
                symbols = [s for s in symbols if s >= 0]
            n = len(symbols) - merge_count(symbols, self.ranks, self.made, self.shift)
            if len(w) <= 64:
                if len(self.words) >= _CACHE_WORDS:
                    self.words.clear()
                self.words[w] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        if self.parted and text.isascii() and text.isalpha():
            return self.word(text.lower())
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        return sum(self.word(w) for w, _ in self.pre_tokenizer.pre_tokenize_str(text) if w)

    def text(self, text: str) -> int:
        if not self.apart or not any(s in text for s in self.special):
            return self.plain(text) if text else 0
        return sum(1 if k % 2 else self.plain(x) for k, x in enumerate(self.apart.split(text)) if x)

    def counts(self, col: pa.Array) -> np.ndarray:
        """Tokens of each text of a column; null counts as empty."""
        if not self.parted:
            return np.fromiter((self.text(x or "") for x in col.to_pylist()), np.int64, len(col))
        raw, off = tk.text_bytes(col)
        starts, ends, doc = tk.word_bounds(raw, off)
        if not len(starts):
            return np.zeros(len(col), np.int64)
        data = raw.tobytes()
        whole = any(s.encode() in data for s in self.special)
        if not whole:
            # No word holds white space, or a letter or digit beside a mark: each part counts by itself.
            kind = _KIND[raw]
            cut = np.flatnonzero(kind[:-1] + kind[1:] == 3) + 1
            edge = np.zeros(len(raw) + 1, bool)
            edge[off] = True
            cut = cut[~edge[cut]]
            starts, ends = (np.sort(np.concatenate([x, cut]), kind="stable") for x in (starts, ends))
            doc = np.searchsorted(off, starts, "right") - 1
            raw = tk.LOWER[raw]
            data = raw.tobytes()
        hashes, first, inverse = np.unique(tk.span_hash(raw, starts, ends, 2 if whole else 0), return_index=True, return_inverse=True)
        if len(self.parts) > _CACHE_WORDS:
            self.parts.clear()
        keys, known = hashes.tolist(), self.parts
        n = np.fromiter((known.get(h, -1) for h in keys), np.int64, len(keys))
        for k in np.flatnonzero(n < 0).tolist():
            n[k] = known[keys[k]] = self.text(data[starts[first[k]] : ends[first[k]]].decode())
        total = np.concatenate([[0], np.cumsum(n[inverse])])
        at = np.searchsorted(doc, np.arange(len(col) + 1))
        return total[at[1:]] - total[at[:-1]]


def counter(path: str) -> TokenCounter:
    if path not in _state:
        _state.clear()
        _state[path] = TokenCounter(path)
    return _state[path]


def _count(path: str, limit: int) -> Callable:
    def fn(batches):
        own = counter(path)
        for batch in batches:
            for part in tk.chunks(batch, "text", 4 * tk.CHUNK_BYTES):
                _, off = tk.text_bytes(part.column("text"))
                n = own.counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return fn


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row's whole text.

    ``docs`` needs ``doc_id`` and ``text``, other columns are left; ``tokenizer``
    is the path, on every executor, of a byte-pair vocabulary file of the
    tokenizers library. Counts are those of that library without begin, end or
    added special tokens. Null and empty texts have 0 tokens; a null doc_id stays
    null; repeated rows give a row each; no rows give none. A text may be of any
    length: a word of n bytes takes time in n log n.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_count(tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
