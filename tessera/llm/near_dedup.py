"""Operator 3, near-duplicate components by MinHash with tensored banding.

A document's set holds the hashes of its distinct five-word shingles. Two collections of ``SIDE`` short keys, each made of
``WIDTH`` minhashes, are combined pairwise into SIDE * SIDE table keys: 100 tables of four minhashes from 40 minhashes
instead of 400. A pair at similarity 0.85 misses all tables with probability 2 (1 - 0.85^2)^10, about 5e-6; at 0.8, 7e-5.
Short keys that one node alone holds go before they are combined, so most documents make no table keys at all.

Equal sets are one node from the start. In each table bucket every node is paired with the bucket's first node and with
its most central one (that of the largest buckets), so pairs grow with the rows, not with the square of a bucket. Pairs are
confirmed on full sets and joined to components; after that only pairs of different components are left. Buckets with few
of them name them; the nodes of the rest are joined on the rarest shingles of their sets (a prefix that any two sets of that
similarity must share), which again is exact, and there only across components. No bucket is capped.

Defined results: null or empty texts and texts without words have an empty set, component doc_id, and are kept; fewer words
than five make one shingle; repeated rows and equal texts share a component; a component's id is its least non-null doc_id;
rows whose component has none (all ids null) have a null component and are kept; ids may be numbers or text; other columns,
whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.common import discard, map_arrow, materialize, small, text_key, text_or_empty

#: Words of a shingle; similarity in hundredths unless the caller names another; keys of each collection; minhashes of a key.
SHINGLE, SIMILAR, SIDE, WIDTH = 5, 85, 10, 2
#: Pairs of different components up to which a bucket names them itself. Both ways give every link of a bucket: this is the
#: cheaper one while the pairs are fewer than the shingles that the other way would move.
FEW = 16
#: Shingles of a prefix by which pairs are told to have met already.
HEAD = 16

_MULT = K.splitmix(2 * SIDE * WIDTH, 71) | K.U64(1)
_XOR = K.splitmix(2 * SIDE * WIDTH, 72)

#: A row's place in its component.
_RANK = "struct(id is null as nameless, id, text_key)"


def _sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows in order, and the offsets of the rows."""
    starts, ends, first = K.words(data, off, K.NOT_SPACE)
    w = K.span_hashes(data, starts, ends)
    g = K.grams(w, SHINGLE)
    out, size = [], np.zeros(len(off) - 1, np.int64)
    for row, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            own = np.unique(g[a : b - SHINGLE + 1]) if b - a >= SHINGLE else K.grams(w[a:b], b - a)
            out.append(own)
            size[row] = len(own)
    return np.concatenate(out) if out else np.zeros(0, K.U64), np.concatenate([[0], np.cumsum(size)])


def _digest(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _signatures(batches):
    for batch in batches:
        for lo, hi, data, off in K.chunks(batch.column(1)):
            n = hi - lo
            s, edge = _sets(data, off)
            full = np.flatnonzero(np.diff(edge))
            short = np.zeros((n, 2 * SIDE), K.U64)
            for i in range(2 * SIDE):
                h = np.zeros(len(full), K.U64)
                for k in range(i * WIDTH, (i + 1) * WIDTH):
                    least = np.minimum.reduceat((s ^ _XOR[k]) * _MULT[k], edge[:-1][full]) if len(full) else h
                    h = h * K._STEP[1] + least
                short[full, i] = K.mix(h + K.U64(i))
            at = np.arange(n + 1) * SIDE
            digests = [_digest(s[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(np.diff(edge)), pa.array(digests, pa.binary()), _lists(short[:, :SIDE].ravel(), at), _lists(short[:, SIDE:].ravel(), at)],
                names=["id", "text_key", "n_shingles", "cls", "left", "right"],
            )


def _set_rows(batches):
    for batch in batches:
        for _, _, data, off in K.chunks(batch.column(0)):
            s, edge = _sets(data, off)
            digests = [_digest(s[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), _lists(s, edge)], names=["cls", "shingles"])


def _ordered(pairs: DataFrame, similar: int) -> DataFrame:
    """Distinct pairs a < b whose sizes allow the similarity."""
    p = pairs.where(F.col("x.node") != F.col("y.node")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    p = p.where(100 * F.least("x.n", "y.n") >= similar * F.greatest("x.n", "y.n"))
    return p.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int, tag: str) -> DataFrame:
    """The pairs that their full sets confirm, written. Only sets that a pair names move."""
    named = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "named")
    own = sets.join(small(named), "node", "left_semi")
    one = own.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = own.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    out = materialize(both.where(100 * common >= similar * (F.size("sa") + F.size("sb") - common)).select("a", "b"), tag)
    discard(named)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the edges (a, b): large-star and small-star rounds
    until nothing changes, each written to the shared folder."""
    e = materialize(edges.select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("p")).where("c > p").distinct(), "links")
    state = None
    while True:
        seen = e.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("c", "p"), F.lit(1 << 40))).alias("h")).first()
        if not seen["n"] or state == tuple(seen):
            break
        state = tuple(seen)
        both = e.select(F.col("c").alias("u"), F.col("p").alias("v")).unionByName(e.select(F.col("p").alias("u"), F.col("c").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("c"), F.col("m").alias("p")).distinct()
        low = large.groupBy("c").agg(F.min("p").alias("m"))
        step = large.join(low, "c")
        moved = step.where("p > m").select(F.col("p").alias("c"), F.col("m").alias("p"))
        before, e = e, materialize(moved.unionByName(low.select("c", F.col("m").alias("p"))).distinct(), "links")
        discard(before)
    out = e.select(F.col("c").alias("node"), F.col("p").alias("root")).unionByName(e.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct())
    out._written = e._written
    return out


def _rare(nodes: DataFrame, sets: DataFrame, similar: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of the given nodes (node, root) of different roots that share one of the rarest shingles of their sets: of n
    shingles, in order of frequency, the first n - ceil(similar n / 100) + 1. Shingles of one node only never make a pair. The written
    table of the prefixes comes with them."""
    x = nodes.join(sets, "node").select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    shared = x.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    y = x.join(shared, "s").groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("by"))
    alone = F.col("n") - F.size("by")  # shingles of this node only come first in the order
    prefix = F.col("n") - F.ceil(F.col("n") * similar / 100) + 1 - alone
    y = y.where(prefix > 0).select("node", "root", "n", alone.alias("alone"), F.transform(F.slice("by", F.lit(1), F.greatest(prefix, F.lit(0)).cast("int")), lambda r: r["s"]).alias("p"))
    kept = y.select(F.struct("node", "n").alias("x"), "root", "alone", F.slice("p", 1, HEAD).alias("head"), F.posexplode("p").alias("place", "s"))
    kept = kept.select("x", "root", "head", "s", (F.col("x.n") - F.col("alone") - F.col("place")).alias("left"))
    # Nodes of one component need no pair: of a shingle's nodes those of its greatest component meet the others only, so a
    # family of copies, all of one component, is not compared with itself.
    by = kept.groupBy("s", "root").agg(F.count("*").alias("k")).groupBy("s").agg(F.count("*").alias("roots"), F.max(F.struct("k", "root")).alias("major"))
    kept = materialize(kept.join(by.where("roots > 1").select("s", F.col("major.root").alias("major")), "s"), "prefixes")
    few = kept.where("root != major")
    other = kept.select(F.col("x").alias("y"), F.col("root").alias("root2"), F.col("head").alias("head2"), "s", F.col("left").alias("left2"))
    # A pair comes once for each shared shingle of the prefixes; where the heads share any, the first one alone counts.
    once = F.coalesce(F.try_element_at(F.array_intersect("head", "head2"), F.lit(1)), F.col("s")) == F.col("s")
    # If this is the first shared shingle, no more are shared than follow it in either set.
    enough = F.least("left", "left2") * (100 + similar) >= similar * (F.col("x.n") + F.col("y.n"))
    return few.join(other, "s").where("root != root2 and (root2 = major or x.node < y.node)").where(enough & once).select("x", "y"), kept


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of ``docs``; links have a similarity of ``similar`` hundredths or more."""
    out = _marked(docs, id_col, text_col, similar)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """``docs`` with one row of each component: of its least id, a null id being the greatest, the row of the least text hash,
    and one of several equal rows. Texts without words and with a null id have no component: one of each text stays."""
    marked = _marked(docs, id_col, text_col, similar)
    keys = marked.groupBy("id", "text_key").agg(F.count("*").alias("n"), F.first("chosen").alias("chosen"), F.first("n_shingles").alias("n_shingles"))
    keys = materialize(keys, "keys")
    blank = keys.where("n_shingles = 0 and id is not null").select("id", "text_key")  # their component is the id
    spare = blank.join(blank.groupBy("id").agg(F.min("text_key").alias("least")), "id").where("text_key != least")
    gone = materialize(keys.where("not chosen").select("id", "text_key").unionByName(spare.select("id", "text_key")), "gone")
    again = materialize(keys.where("chosen and n > 1").select("id", "text_key"), "again")
    names = docs.columns
    here = F.struct(F.col(id_col).alias("id"), text_key(text_col).alias("key"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), here.alias("at"))
    same = lambda t: F.col("at.id").eqNullSafe(t["id"]) & (F.col("at.key") == t["text_key"])
    discard(keys)
    rest = rows.join(small(gone), same(gone), "left_anti")
    if again.isEmpty():
        return rest.select("row.*")
    copies = rest.join(small(again), same(again), "left_semi").groupBy("at").agg(F.any_value("row").alias("row"))
    return rest.join(small(again), same(again), "left_anti").select("row.*").unionByName(copies.select("row.*"))


def _marked(docs: DataFrame, id_col: str, text_col: str, similar: int) -> DataFrame:
    """id, text_key, n_shingles, component_id, kept, and chosen: whether a row has the least id and text hash of its component."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), text_key(text_col).alias("text_key"))
    sig = materialize(rows.transform(map_arrow, _signatures, f"id {kind}, text_key binary, n_shingles long, cls binary, left array<long>, right array<long>"), "signatures")
    nodes = sig.where("n_shingles > 0").groupBy("cls").agg(F.min("id").alias("id"), F.min(F.expr(_RANK)).alias("rank"), F.first("n_shingles").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # Short keys that one node alone holds make no pair: what is left of the others is combined.
    short = nodes.select("node", "n", F.posexplode(F.concat("left", "right")).alias("slot", "key")).select("node", "n", "slot", F.xxhash64("slot", "key").alias("key"))
    held = materialize(short.groupBy("key").agg(F.count("*").alias("held")).where("held > 1").select("key"), "short-keys")
    of = lambda left: F.collect_list(F.when((F.col("slot") < SIDE) == F.lit(left), F.col("key")))
    sides = short.join(small(held), "key", "left_semi").groupBy("node", "n").agg(of(True).alias("left"), of(False).alias("right"))
    sides = materialize(sides.where((F.size("left") > 0) & (F.size("right") > 0)), "sides")
    keys = F.flatten(F.transform("left", lambda x: F.transform(F.col("right"), lambda y: F.xxhash64(x, y))))
    tables = sides.select("node", "n", F.explode(keys).alias("key"))
    shared = materialize(tables.groupBy("key").agg(F.count("*").alias("held"), F.min(F.struct("node", "n")).alias("first")).where("held > 1"), "tables")
    buckets = materialize(tables.join(small(shared), "key").select("key", F.struct("node", "n").alias("x"), "held", "first"), "buckets")
    discard(held, sides, shared)
    # The node with the most company over all tables stands for a bucket, too.
    weight = buckets.groupBy("x").agg(F.sum("held").alias("company"))
    central = buckets.join(weight, "x").groupBy("key").agg(F.max(F.struct("company", "x")).alias("c")).select("key", F.col("c.x").alias("central"))
    stars = buckets.join(central, "key").select("x", F.explode(F.array("first", "central")).alias("y"))
    pairs = materialize(_ordered(stars, similar), "pairs")
    met = materialize(weight.select(F.col("x.node").alias("node")).join(nodes.select("node", "cls", "id"), "node"), "met")
    mark = small(met.select(F.col("id").alias("_id")))
    texts = rows.join(mark, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = texts.transform(map_arrow, _set_rows, "cls binary, shingles array<long>").join(met.select("cls", "node"), "cls").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets, "sets")
    links = _confirmed(pairs, sets, similar, "confirmed")
    found = components(links)
    roots = materialize(found, "roots")
    discard(found)
    # What is left: pairs of different components in one bucket.
    placed = buckets.select("key", "x").join(roots.withColumnRenamed("node", "_n"), F.col("x.node") == F.col("_n"), "left").select("key", "x", F.coalesce("root", "x.node").alias("root"))
    placed = materialize(placed, "placed")
    cells = placed.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("open")).where("open > 0")
    cells = materialize(cells, "open-buckets")
    few = placed.join(small(cells.where(F.col("open") <= FEW).select("key")), "key", "left_semi")
    direct = few.join(few.select("key", F.col("x").alias("y"), F.col("root").alias("root2")), "key").where("root != root2 and x.node < y.node").select("x", "y")
    many = placed.join(small(cells.where(F.col("open") > FEW).select("key")), "key", "left_semi").select(F.col("x.node").alias("node"), "root").distinct()
    late, prefixes = _rare(many, sets, similar)
    rest = materialize(_ordered(direct.unionByName(late), similar).join(pairs, ["a", "b"], "left_anti"), "late-pairs")
    discard(prefixes)
    late = more = _confirmed(rest, sets, similar, "late-confirmed")
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    late = late.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    found = components(late)
    ends = materialize(found, "final-roots")
    discard(found)
    final = ends.select(F.col("node").alias("root"), F.col("root").alias("last"))
    grouped = roots.join(final, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    lone = final.join(roots.select("root"), "root", "left_anti").select(F.col("root").alias("node"), F.col("last").alias("root"))
    grouped = grouped.unionByName(lone).join(nodes.select("node", "cls", "rank"), "node")
    least = grouped.groupBy("root").agg(F.min("rank").alias("_linked"))
    linked = grouped.join(least, "root").select("cls", "_linked")
    named = materialize(nodes.select("cls", "rank").join(linked, "cls", "left").select("cls", F.coalesce("_linked", "rank").alias("_first")), "components")
    discard(nodes, buckets, pairs, met, sets, links, roots, placed, cells, rest, more, ends)
    out = sig.select("id", "text_key", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("_first.id"))
    chosen = F.col("cls").isNull() | (F.col("id").eqNullSafe(F.col("_first.id")) & (F.col("text_key") == F.col("_first.text_key")))
    out = out.select("id", "text_key", "n_shingles", component.alias("component_id"), chosen.alias("chosen"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()))
