"""Operator 5, mixing sources to target weights.

A document's size is its number of words; sources weigh 1, 2, 3, repeating, by code point (null last), and share all sizes
by weight, none above ``MOST`` times its own size (``targets``). A source's documents are permuted by a keyed hash and cut
into blocks of about ``BLOCK_ROWS`` rows, ranges of that hash. As many whole passes as fit the target take every document;
the last, partial pass takes blocks in permuted order, and documents in order within the block where the target falls; there
one document may stand in for another that would leave the sum less near.

The blocks of all passes are divided among output shards by a splitting tree: the shards are halved again and again, the
left half's blocks of each source drawn from a multivariate hypergeometric distribution, so that the shares of every
source stay exact and no block is drawn twice. Each shard then draws the next blocks of each source's permutation and
shuffles its documents locally, by a hash of document and pass.

A row for each source reaches the driver (about 200 bytes; tables of them are broadcast up to the usual number of rows); counts
by block stay in the cluster, and documents move as (id, source, size, hash), never texts. A hot source is spread over its
blocks. Every choice is a function of seed and content, so reruns agree.

Defined results: null texts have size 0; size 0 takes 0; null is a source of its own, the last; repeated rows are separate
documents, which tie in the permutation: as many of them go as fit; empty tables give no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, ship, small, text_or_empty

#: Most times that a source's size is taken, rows of a block, blocks of a stretch, output shards, seed of the permutation.
MOST, BLOCK_ROWS, STRETCH, SHARDS, SEED = 3, 1024, 1024, 16, 7
WEIGHTS = (1, 2, 3)


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, in order of the sources; what is above ``most`` times a source's size
    goes to the others by weight, until none is above."""
    total, n = Fraction(sum(sizes)), len(sizes)
    weight = [Fraction(weights[i % len(weights)]) for i in range(n)]
    out, free, left = [Fraction(0)] * n, set(range(n)), total
    while free:
        whole = sum(weight[i] for i in free)
        share = {i: left * weight[i] / whole for i in free}
        above = {i for i in free if share[i] > most * sizes[i]}
        if not above:
            for i in free:
                out[i] = share[i]
            break
        for i in above:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        free -= above
    return [float(x) for x in out]


def split(blocks: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source for each shard, [shards, sources], by halving."""
    out = np.zeros((shards, len(blocks)), np.int64)

    def halve(lo: int, hi: int, own: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = own
            return
        mid = (lo + hi) // 2
        draw = int(own.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(own, draw, method="marginals") if len(own) else own
        halve(lo, mid, left)
        halve(mid, hi, own - left)

    if shards:
        halve(0, shards, blocks.astype(np.int64))
    return out


def _fitting(block: pa.Table) -> pa.Table:
    """The block where a source's target falls, as kinds of equal documents with their numbers: how many of each the partial
    pass takes. In permuted order every one that leaves the sum within what remains of the target; then, whichever comes
    nearest, one more or one in the place of another."""
    block = block.sort_by([("_h", "ascending"), ("size", "ascending"), ("_id", "ascending")])
    left = block["rest"][0].as_py() - block["_before"][0].as_py()
    size, times = (block[c].to_numpy().astype(np.int64) for c in ("size", "times"))
    takes = np.zeros(len(size), np.int64)
    for i in range(len(size)):
        if 0 < size[i] <= left:
            takes[i] = min(times[i], int(left // size[i]))
            left -= int(takes[i] * size[i])
    more, held = np.flatnonzero((takes < times) & (size > 0)), np.flatnonzero(takes > 0)
    gap, add, drop = abs(left), None, None
    if len(more):
        i = more[np.argmin(size[more])]
        if abs(size[i] - left) < gap:
            gap, add = abs(size[i] - left), i
    if len(more) and len(held):
        held = held[np.argsort(size[held], kind="stable")]
        for k in (-1, 0):  # the taken ones next to what each of the others would have to replace
            at = np.clip(np.searchsorted(size[held], size[more] - left) + k, 0, len(held) - 1)
            off = np.abs(size[more] - size[held[at]] - left)
            j = int(np.argmin(off))
            if off[j] < gap:
                gap, add, drop = off[j], more[j], held[at[j]]
    if add is not None:
        takes[add] += 1
    if drop is not None:
        takes[drop] -= 1
    return block.append_column("takes", pa.array(takes))


def sizes_of(docs: DataFrame, id_col: str, source_col: str, text_col: str, keep: bool = False) -> DataFrame:
    text = text_or_empty(text_col)
    size = F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep else []
    # The hash of the content orders rows with equal ids.
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), size.alias("size"), F.xxhash64(F.lit(SEED), F.col(id_col), text).alias("_h"), *row)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = SHARDS, block_rows: int = BLOCK_ROWS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, keep: bool = False) -> DataFrame:
    """For every row its id, source, size, source_size, target, taken, and draws: an array of (shard, pass, position), one
    for each time that the mix takes the document; a shard is read in order of position. With ``keep`` all columns of
    ``docs`` come first, and those of the mix that would clash with them have the prefix ``mix_``."""
    spark = docs.sparkSession
    ship(spark)
    rows = materialize(sizes_of(docs, id_col, source_col, text_col, keep), "mix-sizes")
    carried = ["_row"] if keep else []
    sums = rows.groupBy("_source").agg(F.sum("size").alias("total"), F.count("*").alias("n")).collect()
    # By code point, which is the order of UTF-8 bytes; null last.
    sums.sort(key=lambda r: (r["_source"] is None, (r["_source"] or "").encode()))
    goal = targets([r["total"] for r in sums], weights, most)
    plan = []
    for i, r in enumerate(sums):
        passes = int(goal[i] // r["total"]) if r["total"] else 0
        passes = min(passes, most)
        rest = goal[i] - passes * r["total"] if r["total"] else 0.0
        plan.append((r["_source"], i, r["total"], goal[i], passes, float(max(rest, 0.0)), -(-r["n"] // block_rows)))
    of_source = lambda df: small(df, len(plan))  # noqa: E731  a table of at most one row a source
    sources = spark.createDataFrame(plan, "_s string, s int, source_size long, target double, passes int, rest double, blocks long")
    keyed = rows.join(of_source(sources), F.col("_source").eqNullSafe(F.col("_s")))
    # A block is a range of the permutation's hash, taken as an unsigned share of its source's blocks.
    share = (F.shiftrightunsigned("_h", 11)).cast("double") / F.lit(float(1 << 53))
    keyed = keyed.withColumn("block", F.least(F.floor(share * F.col("blocks")), F.col("blocks") - 1).cast("long"))
    cells = keyed.groupBy("s", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"), F.first("blocks").alias("blocks"))
    # Words before a block: of the stretches before its own, and of the blocks before it in its stretch.
    cells = materialize(cells.withColumn("stretch", F.floor(F.col("block") / STRETCH)), "mix-cells")
    upto = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = cells.groupBy("s", "stretch").agg(F.sum("words").alias("w")).withColumn("ahead", F.coalesce(F.sum("w").over(upto(["s"], "stretch")), F.lit(0))).drop("w")
    before = F.col("ahead") + F.coalesce(F.sum("words").over(upto(["s", "stretch"], "block")), F.lit(0))
    cells = cells.join(earlier, ["s", "stretch"]).withColumn("before", before)
    cells = materialize(cells.select("s", "block", "words", "before", "rest", "passes", "blocks"), "mix-blocks")
    cells = cells.withColumn("state", F.when(F.col("before") + F.col("words") <= F.col("rest"), 2).when(F.col("before") < F.col("rest"), 1).otherwise(0))
    # Blocks of a source in all its passes: passes times all of them, then those of the partial pass.
    partial = {r["s"]: r["n"] for r in cells.where(F.col("state") > 0).groupBy("s").agg((F.max("block") + 1).alias("n")).collect()}
    drawn = np.array([p[4] * p[6] + partial.get(p[1], 0) for p in plan], np.int64)
    quota = split(drawn, shards)
    edges = [[int(x) for x in col] for col in np.cumsum(quota, axis=0).T]
    shard_of = spark.createDataFrame([(i, e) for i, e in enumerate(edges)], "_s2 int, edges array<long>")
    cut = cells.where(F.col("state") == 1).select(F.col("s").alias("_cs"), F.col("block").alias("_cb"), F.col("before").alias("_before"))
    full = cells.where(F.col("state") == 2).groupBy("s").agg(F.max("block").alias("_full")).select(F.col("s").alias("_fs"), "_full")
    # At most one block a source is cut: its documents go one by one, each that still fits; equal ones are counted first.
    edge = keyed.join(of_source(cut), (F.col("s") == F.col("_cs")) & (F.col("block") == F.col("_cb")))
    kinds = edge.groupBy("s", "_h", "_id", "size", "rest", "_before").agg(F.count("*").alias("times"))
    kinds = materialize(kinds.groupBy("s").applyInArrow(_fitting, T.StructType([*kinds.schema.fields, T.StructField("takes", T.LongType())])), "mix-edge")
    kinds = kinds.select(F.col("s").alias("_es"), F.col("_h").alias("_eh"), F.col("_id").alias("_ei"), F.col("size").alias("_ez"), "times", "takes")
    same = (F.col("s") == F.col("_es")) & (F.col("_h") == F.col("_eh")) & F.col("_id").eqNullSafe(F.col("_ei")) & (F.col("size") == F.col("_ez"))
    columns = ["_id", "_source", "size", "source_size", "target", "passes", "blocks", "s", "block", "last", "_h", *carried]
    some = (F.col("takes") > 0) & (F.col("takes") < F.col("times"))
    whole = edge.join(small(kinds.where(~some)), same).withColumn("last", F.col("takes") > 0).select(*columns)
    # Of equal documents any will do.
    rank = F.row_number().over(Window.partitionBy("s", "_h", "_id", "size").orderBy("_h"))
    part = edge.join(small(kinds.where(some)), same).withColumn("last", rank <= F.col("takes")).select(*columns)
    out = keyed.join(of_source(cut), (F.col("s") == F.col("_cs")) & (F.col("block") == F.col("_cb")), "left_anti").join(of_source(full), F.col("s") == F.col("_fs"), "left")
    out = out.withColumn("last", F.coalesce(F.col("block") <= F.col("_full"), F.lit(False)) & (F.col("rest") > 0))
    both = out.select(*columns).unionByName(whole).unionByName(part).join(of_source(shard_of), F.col("s") == F.col("_s2"))
    times = F.when(F.col("size") > 0, F.col("passes") + F.col("last").cast("int")).otherwise(F.lit(0))
    number = lambda p: p * F.col("blocks") + F.col("block")  # noqa: E731  of a pass's block among all the source's
    draw = lambda p: F.struct(F.size(F.filter("edges", lambda e: e <= number(p))).alias("shard"), p.cast("int").alias("pass"), F.xxhash64(F.lit(SEED), "_h", p).alias("position"))
    draws = F.when(times > 0, F.transform(F.sequence(F.lit(0), times - 1), draw)).otherwise(F.array().cast("array<struct<shard:int,pass:int,position:bigint>>"))
    made = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("size") * times, "draws": draws}
    if keep:
        return both.select("_row.*", *[c.alias(f"mix_{n}" if n in docs.columns else n) for n, c in made.items()])
    return both.select(F.col("_id").alias(id_col), F.col("_source").alias("source"), *[c.alias(n) for n, c in made.items()])


def shard_rows(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each draw: shard, position, pass, id."""
    return mixed.select(F.col(id_col), F.explode("draws").alias("d")).select("d.shard", "d.position", F.col("d.pass").alias("pass"), id_col)
