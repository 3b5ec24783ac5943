"""Operator 8, exact top-k inner products by norm-bucketed retrieval.

Components become floor(SCALE * x). Vectors are dealt by length (norm) over the whole table and cut into buckets of
``BUCKET``; buckets too short for every query of a block are not read. The k-th best product of a query so far, divided by its length and the bucket's greatest length, is the local cosine threshold of a
bucket: above 1 the bucket is skipped, and so is all after it; a high threshold is pruned by coordinates (a vector whose
component on the query's largest coordinate is outside the feasible range can't reach it), a low one by length (only the
vectors long enough, a prefix of the bucket). What is left is verified by integer products; the bounds have slack for
rounding, the products are exact.

The stated query set goes against all rows in blocks of ``BLOCK`` queries, each broadcast to one scan; every task returns
at most k rows a query, merged by query. Each block's results are written before the next one's scan begins. First thresholds come from the ``PROBE`` longest vectors, a fixed number.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id or one that is no whole number; a
shorter vector counts as if filled up with zeros; rows with the query's own id are not its candidates, and other repeated
rows all count, other columns, whatever their names, are not read, ties going to the smaller id; every row of a query's id is searched, equal ones once and counted as often as
they come, and the k best of all its pairs are ranked together; with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, map_arrow, materialize, scratch_path, written

SCALE, BLOCK, BUCKET, PROBE = 1024, 4096, 2048, 2048
#: Cosine thresholds from which coordinates prune instead of lengths.
STEEP = 0.7


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of whole doubles) of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(id_col).try_cast("long").isNotNull() & x.isNotNull() & finite)
    return rows.select(F.col(id_col).try_cast("long").alias("vec_id"), F.transform(x, lambda c: _floor(c * F.lit(float(scale)))).alias("v"))


def _floor(c):
    """floor as a double: a double of 2^53 and more is whole already."""
    return F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c)


def _matrix(col: pa.Array, width: int | None = None) -> np.ndarray:
    rows = [np.asarray(r, dtype=np.float64) for r in col.to_numpy(zero_copy_only=False)]
    width = max([0 if width is None else width, *map(len, rows)])
    if rows and all(len(r) == width for r in rows):
        return np.stack(rows) if width else np.zeros((len(rows), 0))
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact products: by doubles while no partial sum can reach 2^53, else by Python's integers."""
    most = np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(v, axis=1).max(initial=0)
    if most < float(1 << 52):
        return (q @ v.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    out = whole(q) @ whole(v).T
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[min(max(int(x), low), high) for x in r] for r in out], dtype=np.int64).reshape(len(q), len(v))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, floor: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The k best of ``v`` for every query, among those that reach its ``floor`` (a lower bound of its k-th best)."""
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, v))
    length, qlen = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
    order = np.argsort(-length, kind="stable")
    ids, v, length = ids[order], v[order], length[order]
    best_ids = [np.zeros(0, np.int64) for _ in q]
    best = [np.zeros(0, np.int64) for _ in q]
    bound = floor.astype(np.float64)
    focus = np.argmax(np.abs(q), axis=1) if width else np.zeros(len(q), np.int64)
    alive = np.arange(len(q))
    for lo in range(0, len(v), BUCKET):
        bv, bid, blen = v[lo : lo + BUCKET], ids[lo : lo + BUCKET], length[lo : lo + BUCKET]
        reach = qlen[alive] * blen[0] * (1 + 1e-9) + 1
        alive = alive[reach >= bound[alive]]
        if not len(alive):
            break
        local = bound[alive] / np.maximum(qlen[alive] * blen[0], 1e-9)
        steep = local >= STEEP
        gentle = alive[~steep]
        if len(gentle):  # by length: the vectors that some query still can use
            need = ((bound[gentle] - 1) / np.maximum(qlen[gentle] * (1 + 1e-9), 1e-9)).min()
            n = int(np.searchsorted(-blen, -need, "right")) if need > 0 else len(blen)
            if n:
                _merge(gentle, qid, _products(q[gentle], bv[:n]), bid[:n], best_ids, best, bound, k)
        unit = bv / np.maximum(blen, 1e-300)[:, None]
        for i in alive[steep]:  # by coordinate: the feasible range of the query's largest one
            t = min(max((bound[i] - 1) / (qlen[i] * blen[0] * (1 + 1e-9)), 0.0), 1.0)
            c = q[i, focus[i]] / qlen[i]
            half = np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - c * c)) + 1e-6
            u = unit[:, focus[i]]
            # Vectors within arccos t of the query; where they pass the axis itself, that end of the range is open.
            fits = np.flatnonzero(((c < -t) | (u >= c * t - half)) & ((c > t) | (u <= c * t + half)))
            if len(fits):
                one = np.array([i])
                _merge(one, qid, _products(q[one], bv[fits]), bid[fits], best_ids, best, bound, k)
    return best_ids, best


def _merge(which, qid, scores, bid, best_ids, best, bound, k) -> None:
    for row, i in enumerate(which):
        s = scores[row]
        ok = np.flatnonzero((s >= bound[i]) & (bid != qid[i]))
        if not len(ok):
            continue
        if len(ok) > 4 * k:  # the k-th best of this batch is a bound as well
            ok = ok[s[ok] >= np.partition(s[ok], len(ok) - k)[len(ok) - k]]
        best_ids[i], best[i] = _best(np.concatenate([best_ids[i], bid[ok]]), np.concatenate([best[i], s[ok]]), k)
        if len(best[i]) == k:
            bound[i] = max(bound[i], float(best[i][-1]))


def _scan(shared, k: int):
    def run(batches):
        qid, q, floor, times = shared.value
        for batch in batches:
            ids, v = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(batch.column(1))
            best_ids, best = search(qid, q, ids, v, k, floor)
            best_ids, best = ([np.repeat(x, t) for x, t in zip(found, times, strict=True)] for found in (best_ids, best))
            sizes = np.array([len(b) for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, sizes)), pa.array(np.concatenate([*best_ids, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(np.concatenate([*best, np.zeros(0, np.int64)]).astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``every``, its k best other rows."""
    spark = vectors.sparkSession
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    # Dealt and sorted by length once: the files, and the row groups in them, are buckets of all vectors.
    rows = quantise(vectors, id_col, vec_col, scale).withColumn("length", length)
    rows = materialize(rows.repartitionByRange(F.col("length").desc(), "vec_id").sortWithinPartitions(F.col("length").desc(), "vec_id"), "vectors")
    probe = rows.orderBy(F.col("length").desc(), "vec_id").limit(PROBE).toArrow()
    probe_ids, probe_v = probe["vec_id"].to_numpy(), _matrix(probe["v"].combine_chunks() if probe.num_rows else pa.array([], pa.list_(pa.float64())))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = materialize(queries.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("times")), "queries")
    # Blocks of queries by a hash, each of about ``block`` rows in a folder of its own.
    parts = max(1, -(-queries.count() // block))
    if parts > 1:
        whole, at = queries, F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts))
        queries = materialize(whole.withColumn("part", at).repartition("part"), "query-blocks", by="part")
        discard(whole)
    path, done = scratch_path(spark, "found"), False
    for part in range(parts):
        own = (queries.where(F.col("part") == part) if parts > 1 else queries).select("vec_id", "v", "times").toArrow()
        if not own.num_rows:
            continue
        qid, q = own["vec_id"].to_numpy().astype(np.int64), _matrix(own["v"].combine_chunks())
        lowest = np.full(len(qid), -float(1 << 62))
        floor = lowest.copy()
        for i in range(0, len(qid), 256):
            _, best = search(qid[i : i + 256], q[i : i + 256], probe_ids, probe_v, k, lowest[i : i + 256])
            floor[i : i + 256] = [float(b[-1]) if len(b) == k else -float(1 << 62) for b in best]
        shared = spark.sparkContext.broadcast((qid, q, floor, own["times"].to_numpy()))
        # No vector shorter than this reaches any query's floor; the scan skips the files and row groups of such vectors.
        least = float(((floor - 1) / np.maximum(np.linalg.norm(q, axis=1), 1e-9)).min()) * (1 - 1e-6)
        found = (rows.where(F.col("length") >= least) if least > 0 else rows).select("vec_id", "v").transform(map_arrow, _scan(shared, k), "query_id long, vec_id long, score long")
        # A block's results are written before the next begins: its broadcast goes, and the plan stays that of one block.
        _ranked(found, k).write.mode("append").parquet(path)
        shared.destroy()
        done = True
    discard(rows, queries)
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = written(spark, path, T.StructType.fromDDL("query_id long, vec_id long, score long, rank int"))
    # Different vectors of one query id may be in different blocks.
    return (_ranked(found.drop("rank"), k) if parts > 1 else found).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
