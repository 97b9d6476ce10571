"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is normalised and rotated; its code keeps one sign bit per dimension,
packed into 64-bit words, and a correction scalar keeps the inner product of the
code with the vector it stands for. A query's rotated vector is rounded to
``QUERY_BITS`` bit planes, so the inner product of code and query is a sum of
popcounts. From it and the scalar an unbiased estimate of the cosine follows,
with an error bound. Queries meet codes in blocks that carry the original vectors
along: the exact cosines of a query's best estimates in a block give a floor,
candidates whose upper bound reaches it are compared on the original vectors, and
the block's nearest leave it. How many candidates reach the floor costs no disk.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattlake.llm.shared import Scratch

QUERY_BITS = 6


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to one half or more: exact, and norms neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words, zero bits at the end."""
    wide = -(-bits.shape[1] // 64) * 64
    return np.packbits(np.pad(bits, ((0, 0), (0, wide - bits.shape[1]))), axis=1).view(np.uint64)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, and the codes' inner products with them."""
    turned = _unit(x) @ rotation(x.shape[1])
    return _words(turned > 0), np.abs(turned).sum(1) / np.sqrt(x.shape[1])


def bounds(queries: np.ndarray, codes: np.ndarray, correction: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of queries (rows) with coded vectors (columns), and their error bounds, from packed bits."""
    dim = queries.shape[1]
    turned = _unit(queries) @ rotation(dim)
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / (2**QUERY_BITS - 1), 1e-12)
    level = np.round((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    dot = np.zeros((len(queries), len(codes)), np.int32)
    for j in range(QUERY_BITS):
        plane = _words((level >> j) & 1)
        for w in range(codes.shape[1]):
            dot += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int32) << j
    # The code's vector is (2 bit - 1) / sqrt(dim) in every dimension.
    rounded = low * dim + step * level.sum(1, dtype=np.int64)
    inner = (2 * (low[:, None] * ones[None, :] + step[:, None] * dot) - rounded[:, None]) / np.sqrt(dim)
    spread = np.sqrt(np.maximum(0, 1 - correction**2) / max(1, dim - 1))[None, :] + step[:, None] / np.sqrt(12)
    return inner / correction, epsilon * spread / correction


def _vectors(t: pa.Table, name: str = "v") -> np.ndarray:
    v = t.column(name).combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _index(batches):
    """Add codes and corrections; all vectors of a batch that have one length are coded together."""
    for batch in batches:
        n = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(n):
            part = batch.filter(pa.array(n == dim))
            codes, correction = encode(_vectors(pa.Table.from_batches([part])))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(correction)], [*part.schema.names, "code", "correction"])


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, their products added one after another."""
    return np.cumsum(x * y, axis=1)[:, -1]


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact cosines of rows, in double precision."""
    a, b = scaled(a), scaled(b)
    return _dot(a, b) / (np.sqrt(_dot(a, a)) * np.sqrt(_dot(b, b)))


def _best(most: int, epsilon: float):
    """Each query's ``most`` nearest vectors of a block, by exact cosines.

    The cosines of the best estimates give a floor; candidates whose upper bound
    reaches it are reranked on the original vectors, and only the best leave the
    block, of equal ones the smaller ids.
    """

    def fn(queries: pa.Table, data: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and data.num_rows:
            qid, xid = (t.column("gid").to_numpy() for t in (queries, data))
            q, x = _vectors(queries), _vectors(data)
            q_unit, x_unit = _unit(q), _unit(x)
            codes = np.frombuffer(b"".join(data.column("code").to_pylist()), np.uint64).reshape(data.num_rows, -1)
            correction = data.column("correction").to_numpy()
            few = min(4 * most, len(xid))
            for start in range(0, len(q), 128):
                estimate, error = bounds(q[start : start + 128], codes, correction, epsilon)
                first = np.argpartition(-estimate, few - 1, axis=1)[:, :few]
                upper = estimate + error
                for i, u in enumerate(q_unit[start : start + 128]):
                    least = np.sort(x_unit[first[i]] @ u)[-most] - 1e-9 if few >= most else -2.0
                    near = np.union1d(np.flatnonzero(upper[i] >= least), first[i])
                    # Sums in any order differ from the exact ones by far less than 1e-9.
                    rough = x_unit[near] @ u
                    near = near[rough >= (np.partition(rough, -most)[-most] - 1e-9 if len(near) > most else -2.0)]
                    score = _cosines(np.broadcast_to(q[start + i], (len(near), q.shape[1])), x[near])
                    kept = np.lexsort((xid[near], -score))[:most]
                    out.append((np.full(len(kept), qid[start + i]), xid[near[kept]], score[kept]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("query_gid", "gid", "score"), cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return fn


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, epsilon: float = 3.5, query_block: int = 8192, data_block: int = 8192, scratch: Scratch | None = None) -> DataFrame:
    """The ``k`` nearest other vectors of each query by cosine: query_id, rank, vec_id, score.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` tells the queries.
    Every vector is indexed. Equal vectors are indexed once, with the ``k + 1``
    smallest of their ids: no query can get more of them. Distinct queries meet
    distinct codes and vectors in a grid of bounded blocks, each a task's work. ``epsilon``
    is the bounds' number of deviations. Vectors that are null, empty, zero, or
    hold null or non-finite components take no part, nor do rows without vec_id;
    rows that repeat a vec_id count once (the smallest vector). Finite
    components of any size are right. Only vectors of a query's own length are
    candidates. Ties go to the smaller vec_id. Other columns are ignored. A
    query without candidates has no rows, and neither has an empty table.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    one = clean.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("query").alias("query"))
    one = scratch.write(one, "vectors")
    groups = one.groupBy("v").agg(F.min("vec_id").alias("gid"), F.max("query").alias("asked"))
    index = scratch.write(groups.mapInArrow(_index, "v array<double>, gid long, asked boolean, code binary, correction double"), "index")
    # The smallest ids of each distinct vector; the limit on ranks works before the shuffle, so hot vectors send few rows.
    among = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = one.select("v", "vec_id", among.alias("place")).where(F.col("place") <= k + 1)
    members = scratch.write(first.select(F.min("vec_id").over(Window.partitionBy("v")).alias("gid"), "vec_id"), "members")
    asking = scratch.write(one.where("query").join(index.where("asked").select("v", "gid").hint("merge"), "v").select(F.col("vec_id").alias("query_id"), "gid"), "asking")
    size = index.agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).first()
    # Small tables too are dealt to several tasks.
    db, qb = max(1, -(-size["n"] // data_block), min(16, size["n"] // 1024)), max(1, -(-size["q"] // query_block))
    part = lambda n, salt: F.pmod(F.xxhash64("gid", F.lit(salt)), F.lit(n)).cast("int")
    dim = F.size("v").alias("dim")
    x = index.select("gid", "v", "code", "correction", dim, part(db, 2).alias("db"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb")).groupBy("dim", "qb", "db")
    asked = index.where("asked").select("gid", "v", dim, part(qb, 1).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(db - 1))).alias("db")).groupBy("dim", "qb", "db")
    best = lambda key, score, *ties: F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), *ties))
    # k + 1, as the query's own vector is among them. Equal vectors stand for up to k + 1 ids.
    exact = asked.cogroup(x).applyInArrow(_best(k + 1, epsilon), "query_gid long, gid long, score double")
    # Distinct vectors' best k + 1, then their ids' best k + 1, then each query's own without itself.
    top = exact.withColumn("place", best("query_gid", "score", "gid")).where(F.col("place") <= k + 1).select("query_gid", "gid", "score")
    ids = top.join(members, "gid").withColumn("place", best("query_gid", "score", "vec_id")).where(F.col("place") <= k + 1).select("query_gid", "vec_id", "score")
    answer = asking.withColumnRenamed("gid", "query_gid").join(ids, "query_gid").where("query_id <> vec_id")
    return answer.withColumn("rank", best("query_id", "score", "vec_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
