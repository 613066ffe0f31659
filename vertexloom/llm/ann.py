"""Nearest neighbours by randomly rotated one-bit codes.

Every vector, less the mean of all, is rotated at random into CODE_BITS
dimensions and kept as one bit a dimension, with two scalars: its length and the
inner product of its direction with its code. A query's rotated residual is
rounded to QUERY_BITS bits a dimension; popcounts of the packed code under each
of these bit planes give an unbiased estimate of the inner product with a known
error bound. The best by estimate are scored on the vectors; only candidates
whose upper bound reaches the k-th of those scores are reranked besides.

Queries against all rows run in blocks: a block of queries meets each block of
rows in one task of bounded memory, and leaves its k best there. The codes of
all rows are written to the shared folder first.

Defined results: vectors that are null, zero, of another dimension than most,
or hold null or non-finite components take no part; equal scores go by the
smaller vec_id; rows with a null vec_id take no part; rows with a repeated one
are candidates each, but none for a query of that id; queries equal in id and
vector are one, those equal in id alone have k neighbours each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.llm.shared import stored, table

SEED = 20
#: Standard deviations of the estimate's error that the bounds allow; a true neighbour is missed with a chance of about 1e-3.
BOUND = 3.0
#: Bits of a code at least, and of a query's component.
CODE_BITS = 256
QUERY_BITS = 4
#: Rows, and queries, of a block.
BLOCK = 8192


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("v"))


def rotation(d: int) -> np.ndarray:
    """Random orthonormal columns that turn d dimensions into those of a code."""
    bits = max(CODE_BITS, -(-d // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:, :d]


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def encode(rows: DataFrame, d: int, mean: np.ndarray) -> DataFrame:
    """(vec_id, code, length, fit, v): v as doubles' bytes; code packs the signs of the rotated residual."""
    turn = rotation(d)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            r = (v - mean) @ turn.T
            length = np.linalg.norm(r, axis=1)
            fit = np.abs(r).sum(1) / np.maximum(length, 1e-300) / np.sqrt(len(turn))
            packed = np.packbits(r > 0, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(length), pa.array(fit), pa.array([x.tobytes() for x in v], pa.binary())], ["vec_id", "code", "length", "fit", "v"])

    return rows.mapInArrow(code, "vec_id long, code binary, length double, fit double, v binary")


def planes(turned: np.ndarray) -> tuple[float, float, np.ndarray]:
    """A turned query as least value, step and packed bit planes: least + step * (the planes' number) is each component, rounded."""
    least = float(turned.min())
    step = max(float(turned.max()) - least, 1e-300) / ((1 << QUERY_BITS) - 1)
    level = np.rint((turned - least) / step).astype(np.uint8)
    return least, step, np.stack([np.packbits(level >> b & 1).view(np.uint64) for b in range(QUERY_BITS)])


def search(q_ids, q, ids, codes, length, fit, v, mean, turn, k) -> tuple[np.ndarray, ...]:
    """For each of a block of queries its k best among a block of rows: (index of the query, vec_id, score)."""
    d, bits = v.shape[1], len(turn)
    words = np.ascontiguousarray(codes.view(np.uint64).T)
    ones = np.bitwise_count(words).sum(0, dtype=np.int64)
    base, turned, norm = q @ mean, q @ turn.T, np.linalg.norm(q, axis=1)
    fit = np.maximum(fit, 1e-9)
    scale = length / fit / np.sqrt(bits)
    spread = length * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(bits - 1)
    by_component = np.ascontiguousarray(v.T)
    out: list[list[np.ndarray]] = [[], [], []]

    def score(i: int, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for j in range(d):  # in the order of the components, as a plain sum would run
            total += q[i, j] * by_component[j, rows]
        return total

    for i in range(len(q)):
        least, step, masks = planes(turned[i])
        level = np.zeros(len(ids), np.int64)
        for b, mask in enumerate(masks):
            level += sum(np.bitwise_count(w & m).astype(np.int64) for w, m in zip(words, mask)) << b
        # Twice what the set bits pick from the query, less all of it.
        estimate = base[i] + (2 * (least * ones + step * level) - turned[i].sum()) * scale
        error = BOUND * np.hypot(spread * norm[i], scale * step * np.sqrt(bits / 12)) + 1e-6 * (1 + np.abs(estimate))
        own = ids == q_ids[i]
        estimate[own] = -np.inf
        first = np.argpartition(estimate, len(ids) - 2 * k)[len(ids) - 2 * k :] if len(ids) > 2 * k else np.arange(len(ids))
        first = first[~own[first]]
        known = score(i, first)
        bar = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else -np.inf
        more = estimate + error >= bar
        more[first], more[own] = False, False
        more = np.flatnonzero(more)
        near, found = np.concatenate([first, more]), np.concatenate([known, score(i, more)])
        best = np.lexsort((ids[near], -found))[:k]
        for x, y in zip(out, (np.full(len(best), i), ids[near][best], found[best])):
            x.append(y)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): of every query(vec_id, embedding) its k nearest in vectors, itself left out."""
    spark = vectors.sparkSession
    rows = usable(vectors).withColumn("d", F.size("v"))
    dims = rows.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    d = dims["d"] if dims else 1
    n = dims["count"] if dims else 0
    rows = rows.where(F.col("d") == d).select("vec_id", "v")
    mean = np.array(rows.select([F.avg(F.col("v")[i]) for i in range(d)]).first(), dtype=float) if n else np.zeros(d)
    # Blocks by a hash of the id: their number follows the rows, their size doesn't.
    n_blocks = max(1, -(-n // block))
    codes = stored(encode(rows, d, mean).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int")))
    asked = usable(queries).where(F.size("v") == d).distinct()
    q_blocks = max(1, -(-asked.count() // block))
    turn = rotation(d)
    # A query row goes to each block of rows; a task holds one block of rows and one of queries.
    asked = asked.select("vec_id", "v", F.xxhash64("vec_id", "v").alias("nth"))
    asked = asked.withColumns({"q": F.pmod("nth", F.lit(q_blocks)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))})
    held = codes.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def best(key, left, right) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("nth", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        q = _matrix(left.column("v").combine_chunks())
        take = lambda c, t: np.frombuffer(b"".join(right.column(c).to_pylist()), t).reshape(right.num_rows, -1)
        q_ids = left.column("vec_id").to_numpy()
        got = search(q_ids, q, right.column("vec_id").to_numpy(), take("code", np.uint8), right.column("length").to_numpy(), right.column("fit").to_numpy(), take("v", np.float64), mean, turn, k)
        at = got[0].astype(np.int64)
        return pa.table([pa.array(x, t) for x, t in zip((q_ids[at], left.column("nth").to_numpy()[at], *got[1:]), schema.types)], schema=schema)

    found = asked.groupBy("q", "block").cogroup(held.groupBy("q", "block")).applyInArrow(best, "query_id long, nth long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "nth").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
