"""N-gram Jaccard join by chosen paths.

A text is the set of its 5-word shingles. Equal sets collapse first, by digest.
At each level of a run, a set samples its tokens with a hash of (run, level,
token) below ``branching / (threshold * size)``: two sets that reach the
threshold share at least ``branching`` sampled tokens in expectation, so they
stay together with probability ``(1 - exp(-branching)) ** depth`` at worst.
Sets that share a path share a bucket; a bucket above ``leaf`` sets is split
once more on the next level's tokens, a smaller one is compared by brute force
on 128-bit one-bit sketches. A large bucket that is one family of near copies
but for a slice of other sets is not split: these meet the family in slices. Runs repeat until the target recall is met. What a
bucket yields are star edges, one row per set at most. Connected sets then meet
in blocks, where the exact Jaccard similarity of every pair is computed from
the shingles; each pair is met once, and only counts and star edges leave a
block. No candidate or partner is dropped at any size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.llm import textkit as tk
from wattlake.llm.shared import Scratch, connected_components

DEPTH = 3
SLICE = 1024  # sets of one side of a cell of a large bucket
SKETCH_LEAST = 101  # of 128 bits; 0.8 gives 115 with a deviation of 3.4
_FACTORS = tk.mix(np.arange(1, 129, dtype=np.uint64)) | np.uint64(1)

_SET_SCHEMA = "doc_id long, mark long, digest binary, size int, sk1 long, sk2 long, tokens array<array<array<long>>>"


def runs_for(recall: float, branching: float, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold is missed with probability ``1 - recall`` at most."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - math.exp(-branching)) ** depth)))


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text under ``k`` words is one shingle, one without words none."""
    words, doc, _, _ = tk.normal_words(col)
    h, d, _ = tk.shingles(words, doc, k)
    n = len(col)
    at = np.searchsorted(d, np.arange(n + 1))
    first = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for i in range(n):
        if at[i + 1] > at[i]:
            out.append(tk.distinct(h[at[i] : at[i + 1]]))
        elif first[i + 1] > first[i]:
            x = tk.U64(0)
            with np.errstate(over="ignore"):
                for w in words[first[i] : first[i + 1]]:
                    x = x * tk.STEP + w + tk.U64(1)
            out.append(tk.mix(np.array([x], tk.U64)))
        else:
            out.append(np.zeros(0, tk.U64))
    return out


def sketch(s: np.ndarray) -> tuple[int, int]:
    """128 one-bit minhashes, by the same hashes for sets of every size: near copies meet whatever their sizes."""
    least = np.full(128, np.iinfo(np.uint64).max, tk.U64)
    for i in range(0, len(s), 4096):
        for a in range(0, 128, 32):
            h = s[None, i : i + 4096] * _FACTORS[a : a + 32, None]
            h ^= h >> tk.U64(29)
            least[a : a + 32] = np.minimum(least[a : a + 32], h.min(1))
    bits = (least * tk.U64(0x9E3779B97F4A7C15) >> tk.U64(63)).astype(np.uint8)
    return tuple(int(x) for x in np.packbits(bits).view(np.int64))


def _sets(threshold: float, k: int, runs: int, branching: float):
    salts = [[tk.seed(5, r, level) for level in range(DEPTH)] for r in range(runs)]

    def fn(batches):
        import hashlib

        for batch in batches:
            for part in tk.chunks(batch, "text"):
                ids, marks, out = part.column("doc_id").to_pylist(), part.column("mark").to_pylist(), []
                for i, mark, s in zip(ids, marks, shingle_sets(part.column("text"), k), strict=True):
                    if not len(s):
                        out.append((i, mark, None, 0, 0, 0, None))
                        continue
                    rate = branching / (threshold * len(s))
                    most = tk.U64(min(2**64 - 1, int(rate * 2**64)))
                    toks = [[x[x < most].view(np.int64).tolist() for x in (tk.mix(s ^ salt) for salt in levels)] for levels in salts]
                    out.append((i, mark, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), *sketch(s), toks))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "mark", "digest", "size", "sk1", "sk2", "tokens"])

    return fn


def _alike(threshold: float, size: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Which pairs along the last axis neither sizes nor sketches tell apart."""
    z, k1, k2 = size.astype(np.float32), s1.view(np.uint64), s2.view(np.uint64)
    near = np.minimum(z[..., :, None], z[..., None, :]) >= np.float32(threshold - 1e-4) * np.maximum(z[..., :, None], z[..., None, :])
    return near & (np.bitwise_count(k1[..., :, None] ^ k1[..., None, :]) + np.bitwise_count(k2[..., :, None] ^ k2[..., None, :]) <= 128 - SKETCH_LEAST)


def _least_label(near: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The smallest id that each one leads to over ``near``."""
    label = rep
    while True:
        new = np.where(near, label[..., None, :], np.iinfo(np.int64).max).min(-1)
        if np.array_equal(new, label):
            return label
        label = new


def _edge_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["src", "dst"])


def _leaf_edges(threshold: float):
    """Star edges of the alike sets of small buckets; buckets of one size are compared together."""

    def fn(batches):
        for batch in batches:
            members = batch.column("members")
            flat, off = members.flatten(), np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            rep, size, s1, s2 = (flat.field(j).to_numpy(zero_copy_only=False) for j in range(4))
            n = np.diff(off)
            for width in np.unique(n):
                rows = np.flatnonzero(n == width)
                step = max(1, 2_000_000 // int(width * width))
                for a in range(0, len(rows), step):
                    idx = off[rows[a : a + step]][:, None] + np.arange(width)
                    r = rep[idx]
                    label = _least_label(_alike(threshold, size[idx], s1[idx], s2[idx]), r)
                    keep = r != label
                    yield _edge_batch(r[keep], label[keep])

    return fn


def _cell_edges(threshold: float):
    """Edges between families that alike sets of one pair of slices of a large bucket join."""

    def fn(t: pa.Table) -> pa.Table:
        family, size, s1, s2 = (t.column(c).to_numpy() for c in ("family", "size", "sk1", "sk2"))
        label = _least_label(_alike(threshold, size, s1, s2), family)
        _, first = np.unique(np.stack([family, label], 1), axis=0, return_index=True)
        first = first[family[first] != label[first]]
        return pa.Table.from_batches([_edge_batch(family[first], label[first])])

    return fn


def _same_sets():
    """Aggregates that tell buckets of equal members.

    In one run their next tokens split them alike, and where sets are compared
    their run does not matter: one of them stands for all.
    """
    return F.min("run").alias("run"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep", F.lit(1)).cast("decimal(20,0)")).alias("s")


def _families(big: DataFrame, marks: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """rep and family: sets of large buckets whose sketches are like their buckets' first sets' fall together.

    A large group of near copies would stay in one bucket on every path. Its
    members are told by one comparison each, so buckets of a single family need
    no further split, and only what joins different families is looked for.
    """
    first = scratch.write(big.groupBy("path").agg(F.min("rep").alias("head")), "heads")
    head = marks.select(F.col("rep").alias("head"), F.col("size").alias("hs"), F.col("sk1").alias("h1"), F.col("sk2").alias("h2"))
    pairs = big.select("path", "rep").join(first, "path").where("rep <> head").select("rep", "head").distinct().join(marks, "rep").join(head, "head")
    alike = (F.least("size", "hs") >= threshold * F.greatest("size", "hs") - 1e-6) & (F.bit_count(F.col("sk1").bitwiseXOR(F.col("h1"))) + F.bit_count(F.col("sk2").bitwiseXOR(F.col("h2"))) <= 128 - SKETCH_LEAST)
    return pairs.where(alike).select(F.col("rep").alias("src"), F.col("head").alias("dst"))


def _outsiders(big: DataFrame, mains: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """Edges of large buckets with one main family: slices of the family each meet the few other sets."""
    k = F.ceil(F.col("n") / SLICE).cast("int")
    own = F.pmod(F.xxhash64("rep"), k).cast("int")
    place = F.when(F.col("family") == F.col("main"), F.array(own)).otherwise(F.sequence(F.lit(0), k - 1))
    cells = big.join(mains, "path").select("path", "rep", "family", F.explode(place).alias("x")).join(marks, "rep")
    return cells.select("path", "x", "family", "size", "sk1", "sk2").groupBy("path", "x").applyInArrow(_cell_edges(threshold), "src long, dst long")


def _paths(reps: DataFrame, runs: int, leaf: int, threshold: float, scratch: Scratch) -> DataFrame:
    """Edges between sets that share a chosen path and are alike."""
    marks = reps.select("rep", "size", "sk1", "sk2")
    buckets = reps.select("rep", F.posexplode("tokens").alias("run", "levels")).select("rep", "run", F.explode(F.expr("levels[0]")).alias("t")).select("rep", "run", F.xxhash64("run", "t").alias("path"), F.col("rep").alias("family"))
    edges = None
    for level in range(1, DEPTH + 1):
        buckets = scratch.write(buckets, f"paths{level}")
        sized = buckets.groupBy("path").agg(F.count("*").alias("n"), F.min("family").alias("a"), F.max("family").alias("z"))
        sized = scratch.write(sized.where("n > 1 and a < z").select("path", "n"), f"buckets{level}")
        small = buckets.select("path", "rep").join(sized.where(f"n <= {leaf}").select("path"), "path").join(marks, "rep")
        members = small.groupBy("path").agg(F.collect_list(F.struct("rep", "size", "sk1", "sk2")).alias("members")).select("members")
        found = members.mapInArrow(_leaf_edges(threshold), "src long, dst long")
        edges = found if edges is None else edges.union(found)
        big = buckets.join(sized.where(f"n > {leaf}").select("path"), "path")
        if level == 1:
            same = scratch.write(_families(big, marks, threshold, scratch), "families")
            edges = edges.union(same)
            family = scratch.write(connected_components(same).select(F.col("node").alias("rep"), F.col("component").alias("of")), "family")
            big = big.join(family, "rep", "left").withColumn("family", F.coalesce("of", "family")).drop("of")
        if level < DEPTH:
            big = scratch.write(big, f"big{level}")
            most = big.groupBy("path", "family").agg(F.count("*").alias("m"), *_same_sets()).groupBy("path")
            most = most.agg(F.sum("m").alias("n"), F.max(F.struct("m", "family")).alias("top"), F.min("run").alias("run"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))
            most = scratch.write(most.select("path", "n", "run", "x", "s", F.col("top.family").alias("main"), (F.col("n") - F.col("top.m")).alias("others")).where("others > 0"), f"mains{level}")
            met = most.where(f"others <= {SLICE}").groupBy("n", "x", "s").agg(F.min(F.struct("path", "main")).alias("one"))
            edges = edges.union(_outsiders(big, met.select("one.path", "n", "one.main"), marks, threshold))
            big = big.join(most.where(f"others > {SLICE}").groupBy("run", "n", "x", "s").agg(F.min("path").alias("path")).select("path"), "path")
            split = big.join(reps.select("rep", "tokens"), "rep")
            buckets = split.select("rep", "run", "path", "family", F.explode(F.expr(f"tokens[run][{level}]")).alias("t")).select("rep", "run", F.xxhash64("path", "t").alias("path"), "family")
        else:
            # Still together on every level: slices of the bucket meet in pairs.
            big = scratch.write(big, f"big{level}")
            once = big.groupBy("path").agg(F.count("*").alias("n"), *_same_sets()).groupBy("n", "x", "s").agg(F.min("path").alias("path"))
            sliced = big.join(scratch.write(once.select("path", "n"), "once"), "path").join(marks, "rep").withColumn("k", F.ceil(F.col("n") / SLICE).cast("int")).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
            cells = sliced.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")).select("path", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "family", "size", "sk1", "sk2")
            edges = edges.union(cells.groupBy("path", "x", "y").applyInArrow(_cell_edges(threshold), "src long, dst long"))
    return edges.distinct()


def _links(threshold: float, side: np.ndarray, rep: np.ndarray, copies: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with links, the smallest id each leads to here, and each one's number of linked rows."""
    size = np.array([len(p) for p in parts])
    n, a = len(rep), int((side == 0).sum())
    owner = np.repeat(np.arange(n), size)
    _, code, seen = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    keep = seen[code] > 1
    code, owner = (np.cumsum(seen > 1) - 1)[code[keep]], owner[keep]
    rows, cols = (np.arange(a), np.arange(a, n)) if 0 < a < n else (np.arange(n), np.arange(n))
    inter = np.zeros((len(rows), len(cols)), np.float32)
    by = np.argsort(code, kind="stable")
    code, owner = code[by], owner[by]
    width = 4096
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        i, j = np.searchsorted(code, [lo, lo + width])
        m = np.zeros((n, int(code[j - 1]) - lo + 1), np.float32)
        m[owner[i:j], code[i:j] - lo] = 1
        inter += m[rows] @ m[cols].T
    link = inter >= threshold * (size[rows][:, None] + size[cols][None, :] - inter) - 1e-6
    count = np.zeros(n, np.int64)
    if len(rows) == n:
        np.fill_diagonal(link, False)
    else:
        count[cols] += link.T @ copies[rows]
    count[rows] += link @ copies[cols]
    label, far = rep.copy(), np.iinfo(np.int64).max
    while True:
        new = label.copy()
        new[rows] = np.minimum(new[rows], np.where(link, new[cols][None, :], far).min(1, initial=far))
        new[cols] = np.minimum(new[cols], np.where(link, new[rows][:, None], far).min(0, initial=far))
        if np.array_equal(new, label):
            break
        label = new
    hit = count > 0
    return rep[hit], label[hit], count[hit]


def _verify(threshold: float):
    """Exact links of one pair of blocks, of one block, or of a pack of small components."""

    def fn(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        component, side, rep, copies = (t.column(c).to_numpy() for c in ("component", "side", "rep", "copies"))
        vals = t.column("shingles").combine_chunks()
        off, flat = vals.offsets.to_numpy().astype(np.int64), vals.values.to_numpy(zero_copy_only=False)
        order = np.lexsort((rep, side, component))
        cut = np.flatnonzero(np.diff(component[order])) + 1
        got = [_links(threshold, side[o], rep[o], copies[o], [flat[off[i] : off[i + 1]] for i in o]) for o in np.split(order, cut)]
        return pa.table({c: pa.array(np.concatenate([g[j] for g in got]), pa.int64()) for j, c in enumerate(("rep", "dst", "links"))})

    return fn


def _packed(batches):
    """Texts as Zstandard frames, so that the shuffle to their components carries less."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for part in tk.chunks(batch, "text"):
            frames = [pack(t.encode()) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(frames, pa.binary())], ["doc_id", "mark", "packed"])


def _shingles_of(k: int):
    kept = ["rep", "component", "copies", "n"]

    def fn(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                text = pa.array([unpack(p).decode() for p in some.column("packed").to_pylist()], pa.string())
                some = pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), text], [*kept, "text"])
                for part in tk.chunks(some, "text"):
                    sets = [s.view(np.int64) for s in shingle_sets(part.column("text"), k)]
                    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                    arrays = [*(part.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, [*kept, "shingles"])

    return fn


def marked_join(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9999, branching: float = 3.0, leaf: int = 128, block: int = 512, scratch: Scratch | None = None) -> DataFrame:
    """Links between texts whose ``k``-word shingle sets reach ``threshold``, and their groups.

    ``docs`` needs ``doc_id`` (long) and ``text``. Returns one row per input row:
    ``doc_id``, ``mark`` (xxhash64 of the text), ``copy_id`` (smallest doc_id
    with the same shingle set), ``class_id`` (smallest doc_id that links lead
    to), ``n_links`` (other rows at the threshold or above, copies included),
    ``group`` (a number of the class, null where a row can't link).
    Words are lower-cased runs of letters, marks and digits.

    A text under ``k`` words counts as one shingle. Null and empty texts, or
    texts without a word, have no shingles and link to nothing. A null doc_id is
    a row of its own: it links to nothing. Rows that repeat a doc_id with the
    same text are copies of each other; with different texts each row has the
    links of its own text. Very long texts are compared whole. Other columns
    are ignored. Empty input gives no rows.
    """
    runs, scratch = runs_for(recall, branching), scratch or Scratch(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    sets = scratch.write(src.mapInArrow(_sets(threshold, k, runs, branching), _SET_SCHEMA), "sets")
    known = sets.where("doc_id is not null and digest is not null")
    # A set's number is its own, whatever doc_ids its texts have; its home is the text that stands for it.
    one = known.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("home"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sk1").alias("sk1"), F.first("sk2").alias("sk2"), F.first("tokens").alias("tokens"))
    reps = scratch.write(one.select(F.monotonically_increasing_id().alias("rep"), "digest", F.col("home.doc_id").alias("doc_id"), F.col("home.mark").alias("mark"), "copies", "size", "sk1", "sk2", "tokens"), "reps")
    edges = scratch.write(_paths(reps, runs, leaf, threshold, scratch), "edges")
    scratch.keep("sets", "reps", "edges")
    comp = scratch.write(connected_components(edges), "components")
    sizes = scratch.write(comp.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    comp = scratch.write(comp.join(sizes, "component"), "sized")
    members = reps.select("rep", "doc_id", "mark", "copies").join(comp.withColumnRenamed("node", "rep"), "rep")
    packed = src.where("doc_id is not null and text is not null").mapInArrow(_packed, "doc_id long, mark long, packed binary")
    text = packed.join(members, ["doc_id", "mark"]).groupBy("doc_id", "mark", "rep", "component", "copies", "n").agg(F.min("packed").alias("packed"))
    shingled = text.select("rep", "component", "copies", "n", "packed").mapInArrow(_shingles_of(k), "rep long, component long, copies long, n long, shingles array<long>")
    # Deal the sets of a large component to salted blocks, pack small components together.
    packs = max(1, comp.count() // 500)
    blocks = F.ceil(F.col("n") / block).cast("int")
    parts = shingled.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = parts.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select(
        F.when(F.col("blocks") > 1, F.col("component")).otherwise(-1).alias("solo"),
        F.when(F.col("blocks") > 1, -1).otherwise(F.pmod(F.xxhash64("component"), F.lit(packs))).alias("pack"),
        F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"), "component", "rep", "copies", "shingles",
    )
    links = scratch.write(cells.groupBy("solo", "pack", "x", "y").applyInArrow(_verify(threshold), "rep long, dst long, links long"), "links")
    scratch.keep("sets", "reps", "links")
    groups = connected_components(links.select(F.col("rep").alias("src"), F.col("dst")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = scratch.write(reps.select("digest", "rep", "doc_id", "copies").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").join(counts, "rep", "left"), "of_rep")
    least = scratch.write(of_rep.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id")), "least")
    classes = of_rep.join(least, "component", "left").select("digest", F.col("doc_id").alias("copy_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "rep").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classes = scratch.write(classes, "classes")
    scratch.keep("sets", "classes")
    found = known.select("doc_id", "mark", "digest").join(classes, "digest", "left").select("doc_id", "mark", "copy_id", "class_id", "n_links", "group")
    alone = sets.where("doc_id is null or digest is null").select("doc_id", "mark", F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("group"))
    return found.union(alone)


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """``marked_join`` without the texts' hashes and groups' numbers: doc_id, copy_id, class_id, n_links of every row."""
    return marked_join(docs, **options).drop("mark", "group")


def near_duplicate_groups(docs: DataFrame, **options) -> DataFrame:
    """``jaccard_join`` without the links' counts: doc_id and class_id."""
    return jaccard_join(docs, **options).select("doc_id", "class_id")


__all__ = ["jaccard_join", "marked_join", "near_duplicate_groups", "runs_for", "shingle_sets", "sketch"]
