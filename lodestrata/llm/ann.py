"""Approximate nearest neighbours by collision-counting hashing.

Each vector is projected on PROJECTIONS random directions; for every direction the projections of a
block of vectors are kept in a sorted array. A query is projected alike; in every array a window
centred on the query's projection is widened round by round (virtual rehashing: the window of a larger
radius holds that of a smaller one), and only the places that a round opens at the two ends are walked
and counted. A vector that falls into the windows of at least a share ALPHA of the directions is
verified by its true inner product. A query's search in a block ends when the window radius has reached
the distance at which no better vector is expected, see `search`.

Largest inner product is nearest distance after one more component is added to every vector, which
brings all to the largest norm; queries get 0 there.

The stated query set is searched against all vectors block by block: vectors and queries are packed
into blocks of bounded size, every query block meets every vector block, each meeting yields the best
K per query, and the best K of those are kept per query. Every vector is indexed.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part;
shorter vectors are filled with zeros; a null vec_id takes no part (nothing could name it); rows that
repeat a vec_id are candidates of their own, and all rows of the query's own id are left out; equal
scores go to the smaller vec_id; with fewer than K candidates all are returned; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, done, staged

K = 20
PROJECTIONS = 96
#: Share of the directions in whose windows a vector must fall to be verified. Wide windows tell near from far best: what
#: lies outside is rare for the near, and few places are walked.
ALPHA = 0.85
#: The first radius, as a share of that at which a vector without any likeness is expected to pass, and its growth.
FIRST, GROWTH = 0.76, 1.08
#: Standard deviations of safety in the test that ends a search.
SAFETY = 1.3
BLOCK_BYTES = 8 << 20
#: Vectors of a block and queries of a chunk, at most about.
BLOCK_ROWS, CHUNK_ROWS = 32_000, 1024
FOUND = "query_id long, vec_id long, score double"


def directions(dims: int, n: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, dims))


def centred_share(alpha: float) -> float:
    """The half-width, in standard deviations, that holds a share alpha of a normal distribution."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(0.5 + alpha / 2)


def exact(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order."""
    return (vectors.astype(np.float64) * q).sum(axis=1)


def places(arrays: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of a value in each sorted array, before equal ones."""
    rows = np.arange(len(arrays))
    low, high = np.zeros(len(arrays), np.int64), np.full(len(arrays), arrays.shape[1], np.int64)
    for _ in range(arrays.shape[1].bit_length()):
        mid = (low + high) >> 1
        less = (low < high) & (arrays[rows, np.minimum(mid, arrays.shape[1] - 1)] < values)
        low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
    return low


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, top_norm: float, k: int = K, projections: int = PROJECTIONS, safety: float = SAFETY):
    """For each query (position, vec_ids, scores, vectors verified) of the best k found in this block.

    A vector at distance d from the query has projections normal around the query's with deviation d,
    so a window of half-width w holds it in a share P(|N| < w/d) of the directions. It is expected to
    pass the threshold ALPHA once w reaches d times the matching quantile; `safety` deviations of the
    share's spread are added. The search ends when this holds for the distance of the k-th best found;
    once k are found, the radius grows no further than that.

    The first windows are walked whole, or what lies outside them where that is less; every later round
    walks what it opens.
    """
    wide = vectors.astype(np.float64)
    extra = np.sqrt(np.maximum(0.0, top_norm**2 - (wide * wide).sum(axis=1)))
    a = directions(vectors.shape[1] + 1, projections)
    own = (np.concatenate([wide, extra[:, None]], axis=1) @ a.T).T
    del wide
    probe = queries.astype(np.float64) @ a[:, :-1].T
    m, n = own.shape
    order = np.argsort(own, axis=1, kind="stable")
    arrays = np.take_along_axis(own, order, axis=1)
    del own
    need = int(np.ceil(ALPHA * m))
    widen = centred_share(min(0.999, ALPHA + safety * np.sqrt(ALPHA * (1 - ALPHA) / m)))
    norms2 = (queries.astype(np.float64) ** 2).sum(axis=1)

    room = np.empty(m * n, order.dtype)  # used again by every walk

    def walked(*ranges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """How often each vector lies in the given ranges of places of the arrays."""
        parts = [order[j, s:e] for begin, end in ranges for j, (s, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)) if s < e]
        if not parts:
            return np.zeros(n, np.int64)
        return np.bincount(np.concatenate(parts, out=room[: sum(map(len, parts))]), minlength=n)

    for i in range(len(queries)):
        q = queries[i].astype(np.float64)
        q_own = queries[i].astype(vectors.dtype)
        slack = 1e-4 * np.sqrt(norms2[i]) * top_norm
        open_to = ids != query_ids[i]
        best_ids, best, verified = np.zeros(0, np.int64), np.zeros(0), 0
        radius = FIRST * widen * np.sqrt(norms2[i] + top_norm**2)
        low, high = places(arrays, probe[i] - radius), places(arrays, np.nextafter(probe[i] + radius, np.inf))
        if 2 * (high - low).sum() > m * n:  # what lies outside is less: it is walked and taken off
            hits = m - walked((np.zeros(m, np.int64), low), (high, np.full(m, n)))
        else:
            hits = walked((low, high))
        while True:
            fresh = np.flatnonzero((hits >= need) & open_to)
            if len(fresh):
                open_to[fresh] = False
                verified += len(fresh)
                if len(fresh) > 4 * k:  # a quick product first; whatever may be among the best k is computed exactly
                    quick = vectors[fresh] @ q_own
                    fresh = fresh[quick >= np.partition(quick, len(quick) - k)[len(quick) - k] - slack]
                best_ids = np.concatenate([best_ids, ids[fresh]])
                best = np.concatenate([best, exact(vectors[fresh], q)])
                if len(best) > k:
                    top = np.lexsort((best_ids, -best))[:k]
                    best_ids, best = best_ids[top], best[top]
            if not open_to.any():
                break
            grown = radius * GROWTH
            if len(best) >= k:
                target = widen * np.sqrt(max(0.0, norms2[i] + top_norm**2 - 2 * best.min()))
                if radius >= target:
                    break
                grown = min(grown, target)
            radius = grown
            wider_low, wider_high = places(arrays, probe[i] - radius), places(arrays, np.nextafter(probe[i] + radius, np.inf))
            hits += walked((wider_low, low), (high, wider_high))
            low, high = wider_low, wider_high
        top = np.lexsort((best_ids, -best))[:k]
        yield i, best_ids[top], best[top], verified


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part; v keeps its element type."""
    v = F.col(vector_column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine & F.exists("v", lambda x: x != 0))


def pack(rows: DataFrame, dims: int, blocks: int, salt: str, kind: str) -> DataFrame:
    """(block, ids, data): rows dealt by a hash into blocks, each block's matrix packed as bytes."""

    def join(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("vec_id"), np.int64)
        v = group.column("v").combine_chunks()
        sizes = np.diff(np.asarray(v.offsets))
        data = np.zeros((len(ids), dims), kind)
        data[np.arange(dims)[None, :] < sizes[:, None]] = np.asarray(v.flatten()).astype(kind)
        order = np.argsort(ids, kind="stable")
        return pa.table({"block": group.column("block").slice(0, 1), "ids": pa.array([ids[order].tobytes()], pa.binary()), "data": pa.array([data[order].tobytes()], pa.binary())})

    # Rows alike in all are dealt out too: the table is staged, so a row's number stays with it.
    placed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.lit(salt), F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    return placed.select("block", "vec_id", "v").groupBy("block").applyInArrow(join, "block int, ids binary, data binary")


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each query, a query's own id left out."""
    spark = vectors.sparkSession
    all_rows = staged(usable(vectors, id_column, vector_column), "ann-vectors")
    wanted = staged(usable(queries, id_column, vector_column), "ann-queries")
    kind = "<f4" if "float" in dict(all_rows.dtypes)["v"] and "float" in dict(wanted.dtypes)["v"] else "<f8"
    wide = F.transform("v", lambda x: x.cast("double"))
    bounds = all_rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))).alias("norm")).first()
    probes = wanted.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    dims, norm = max(bounds["dims"] or 1, probes["dims"] or 1), bounds["norm"] or 0.0
    n_blocks = max(1, -(-(bounds["n"] * dims * int(kind[-1])) // BLOCK_BYTES), -(-bounds["n"] // BLOCK_ROWS))
    n_chunks = max(1, -(-probes["n"] // CHUNK_ROWS))
    packed = staged(pack(all_rows, dims, n_blocks, "v", kind), "ann-blocks")
    # Each chunk of queries goes to every block of vectors: the stated query set against all rows.
    chunks = pack(wanted, dims, n_chunks, "q", kind).select(F.col("block").alias("chunk"), F.col("ids").alias("query_ids"), F.col("data").alias("query_data")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    chunks = staged(chunks, "ann-chunks")
    meetings = chunks.join(packed, "block")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, data, qids, qdata = (b.column(x)[i].as_py() for x in ("ids", "data", "query_ids", "query_data"))
                qids = np.frombuffer(qids, np.int64)
                found = [x[:3] for x in search(np.frombuffer(qdata, kind).reshape(-1, dims), qids, np.frombuffer(data, kind).reshape(-1, dims), np.frombuffer(ids, np.int64), norm, k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(x), qids[j]) for j, x, _ in found])), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))], schema=schema)

    with batches_of(spark, 1):
        parts = staged(meetings.repartition(max(1, min(n_blocks * n_chunks, 8192)), "block", "chunk").select("ids", "data", "query_ids", "query_data").mapInArrow(run, FOUND), "ann-found")
    done(all_rows, wanted, packed, chunks)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(own).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
