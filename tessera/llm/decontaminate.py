"""Operator 7, benchmark decontamination by winnowing.

Words are runs of letters, digits and bytes beyond ASCII, with A-Z lowered. Each benchmark item gives its windows of
``SPAN`` words, or itself as one window if it is shorter. Of every window the least hash of its k-grams is kept: the
fingerprint. Equal windows have equal fingerprints, so a document need only look up its own winnowed fingerprints, which
are about 2 / (width + 1) of its k-grams; each hit is extended to the windows around it, which are compared by the hash of
all their words. Every shared span of ``SPAN`` words is found, none is sampled away.

A benchmark of up to ``INDEX_ROWS`` windows goes to the executors as an index, and documents are scanned once. A larger one
stays where it is: the documents' scan keeps the windows whose fingerprint is marked in a bitmap of fixed size, and these
are joined to the benchmark's windows by all their words. Both ways give the same rows.

Defined results: null or empty texts have no words and no hits; items without words have no windows; repeated items and
items with equal ids count once; items with a null id mark words but are not listed; repeated documents get equal rows;
an empty benchmark leaves every document clean, and no documents give no rows; columns other than the id and the text
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.common import map_arrow, materialize, small, text_key, text_or_empty

#: Words of a window, words of a k-gram, windows of a benchmark up to which it is broadcast (about 40 bytes each).
SPAN, GRAM, INDEX_ROWS = 13, 5, 250_000

#: Bits of the map of fingerprints by which a larger benchmark's candidates are told (16 MB).
BITS = 1 << 27

_COUNTED = "n_hit long, items array<string>"


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = K.words(data, off, K.ALNUM)
    return K.span_hashes(data, starts, ends), first


def _at(w: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """``K.grams`` at the given places only."""
    h = w[begin] * K._STEP[0]
    for k in range(1, size):
        h += w[begin + k] * K._STEP[k % 64]
    h += K.U64(size)
    return K.mix(h)


def _windows(batches):
    """Benchmark items to (size, fingerprint, window, item)."""
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, off in K.chunks(batch.column(1)):
            w, first = _words(data, off)
            for row in range(lo, hi):
                own = w[first[row - lo] : first[row - lo + 1]]
                if not len(own):
                    continue
                size = min(SPAN, len(own))
                gram = min(GRAM, size)
                least, whole = K.window_min(K.grams(own, gram), size - gram + 1), K.grams(own, size)
                n = len(whole)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(least.view(np.int64)), pa.array(whole.view(np.int64)), pa.array([ids[row].as_py()] * n, pa.string())], names=["size", "fingerprint", "window", "item"])


def _index(rows: list) -> dict[int, tuple]:
    """By window size: fingerprints, windows (both sorted), and the items of each window."""
    out = {}
    for size in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == size]
        windows = np.array([r[2] for r in own], np.int64).view(K.U64)
        distinct, which = np.unique(windows, return_inverse=True)
        items: list[set[str]] = [set() for _ in distinct]
        for r, k in zip(own, which, strict=True):
            if r[3] is not None:
                items[k].add(r[3])
        out[size] = np.unique(np.array([r[1] for r in own], np.int64).view(K.U64)), distinct, [tuple(sorted(s)) for s in items]
    return out


def _member(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values, at


def _hits(w: np.ndarray, first: np.ndarray, index: dict[int, tuple]):
    """(window size, place of the window's first word, number of the window in the index) of all rows' occurrences."""
    end = np.repeat(first[1:], np.diff(first))
    for size, (fingerprints, windows, _) in index.items():
        gram = min(GRAM, size)
        least = K.window_min(K.grams(w, gram), size - gram + 1)
        if not len(least):
            continue
        turns = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        known = _member(least[turns], fingerprints)[0]
        runs = np.diff(np.append(turns, len(least)))
        place = K.ranges(turns[known], runs[known])
        place = place[place + size <= end[place]]
        if len(place):
            found, which = _member(_at(w, place, size), windows)
            if found.any():
                yield size, place[found], which[found]


def _scan(index):
    """key, n_words, the number of words that occurring windows cover, and their items."""

    def run(batches):
        table = index.value
        for batch in batches:
            for lo, hi, data, off in K.chunks(batch.column(1)):
                w, first = _words(data, off)
                n = hi - lo
                begin: list[list[int]] = [[] for _ in range(n)]
                sizes: list[list[int]] = [[] for _ in range(n)]
                items: list[set[str]] = [set() for _ in range(n)]
                for size, place, which in _hits(w, first, table) if len(w) else ():
                    rows = np.searchsorted(first, place, "right") - 1
                    named = table[size][2]
                    for r, p, k in zip(rows.tolist(), (place - first[rows]).tolist(), which.tolist(), strict=True):
                        begin[r].append(p)
                        sizes[r].append(size)
                        items[r].update(named[k])
                named_items = pa.array([sorted(s) for s in items], pa.list_(pa.string()))
                hit = [_cover(b, s) for b, s in zip(begin, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(np.diff(first), pa.int64()), pa.array(hit, pa.int64()), named_items], names=["key", "n_words", "n_hit", "items"])

    return run


def _cover(begin: list[int], sizes: list[int]) -> int:
    return len(np.unique(K.ranges(np.array(begin, np.int64), np.array(sizes, np.int64)))) if begin else 0


def _bitmap(windows: DataFrame) -> np.ndarray:
    """One bit for each of ``BITS`` values of a fingerprint's lowest bits: set if a window has such a fingerprint."""
    low = windows.select((F.col("fingerprint").bitwiseAND(F.lit(BITS - 1)) + 1).alias("f"))
    parts = low.groupBy(F.bitmap_bucket_number("f").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("f")).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts.collect():  # BITS / 8 bytes at most
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["k"] - 1) * len(bits) : r["k"] * len(bits)] = bits
    return out


def _candidates(shared):
    """key, n_words, and the windows whose fingerprint may be the benchmark's: size, hash of all words, first word."""

    def run(batches):
        bits, spans = shared.value
        for batch in batches:
            for lo, hi, data, off in K.chunks(batch.column(1)):
                w, first = _words(data, off)
                n = hi - lo
                end = np.repeat(first[1:], np.diff(first))
                found: list[tuple] = []
                for size in spans:
                    gram = min(GRAM, size)
                    least = K.window_min(K.grams(w, gram), size - gram + 1)
                    if not len(least):
                        continue
                    turns = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                    at = (least[turns] & K.U64(BITS - 1)).astype(np.int64)
                    known = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                    place = K.ranges(turns[known], np.diff(np.append(turns, len(least)))[known])
                    place = place[place + size <= end[place]]
                    found.append((np.full(len(place), size, np.int32), _at(w, place, size), place))
                size, whole, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32), np.zeros(0, K.U64), np.zeros(0, np.int64))
                order = np.argsort(place, kind="stable")
                row = np.searchsorted(first, place[order], "right") - 1
                edge = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edge, pa.array(v)) for v in (size[order], whole[order].view(np.int64), (place[order] - first[row]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(np.diff(first), pa.int64()), *lists], names=["key", "n_words", "sizes", "windows", "places"])

    return run


def _covered(batches):
    """The number of distinct words that a document's windows cover."""
    for batch in batches:
        hit = [_cover([h["place"] for h in hits.as_py()], [h["size"] for h in hits.as_py()]) for hits in batch.column("hits")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(hit, pa.int64())], names=["key", "n_hit"])


def _joined(rows: DataFrame, windows: DataFrame, kind: str) -> DataFrame:
    """key (of type ``kind``), n_words, n_hit, items of every row (key, text), by joins: for benchmarks of any size."""
    spark = rows.sparkSession
    spans = sorted(r["size"] for r in windows.select("size").distinct().collect())  # SPAN at most
    shared = spark.sparkContext.broadcast((_bitmap(windows), spans))
    seen = materialize(rows.transform(map_arrow, _candidates(shared), f"key {kind}, n_words long, sizes array<int>, windows array<long>, places array<int>"), "benchmark-candidates")
    each = seen.where(F.size("windows") > 0).select("key", F.explode(F.arrays_zip("sizes", "windows", "places")).alias("c"))
    each = each.select("key", F.col("c.sizes").alias("size"), F.col("c.windows").alias("window"), F.col("c.places").alias("place"))
    hits = materialize(each.join(windows.select("size", "window").distinct(), ["size", "window"], "left_semi").distinct(), "benchmark-hits")
    cover = hits.groupBy("key").agg(F.collect_list(F.struct("place", "size")).alias("hits")).transform(map_arrow, _covered, f"key {kind}, n_hit long")
    named = hits.select("key", "size", "window").distinct().join(windows.where("item is not null").select("size", "window", "item"), ["size", "window"])
    named = named.select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = cover.join(named, cover["key"].eqNullSafe(named["key"]), "left").select(cover["key"].alias("_k"), "n_hit", "items")
    out = seen.select("key", "n_words").join(both, F.col("key").eqNullSafe(F.col("_k")), "left")
    return out.select("key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: int = 20) -> DataFrame:
    """id, n_words, n_hit, items (ids with occurring windows, sorted as strings), contaminated, for every row of ``docs``.
    A document is contaminated if it has hit words and they are at least one in ``share`` of its words."""
    spark = docs.sparkSession
    windows = benchmark.select(F.col(item_col).cast("string"), text_or_empty(item_text)).transform(map_arrow, _windows, "size int, fingerprint long, window long, item string")
    windows = materialize(windows.distinct(), "benchmark-windows")
    kind = docs.schema[id_col].dataType.simpleString()
    if windows.count() <= INDEX_ROWS:
        index = spark.sparkContext.broadcast(_index([tuple(r) for r in windows.collect()]))
        out = docs.select(F.col(id_col), text_or_empty(text_col)).transform(map_arrow, _scan(index), f"{id_col} {kind}, n_words long, {_COUNTED}")
    else:
        # Rows of one id may have different texts.
        keyed = docs.select(F.struct(F.col(id_col).alias("id"), text_key(text_col).alias("digest")).alias("key"), text_or_empty(text_col))
        out = _joined(keyed, windows, f"struct<id:{kind},digest:binary>").select(F.col("key.id").alias(id_col), "n_words", "n_hit", "items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents."""
    keyed = docs.select(text_key(text_col).alias("_key"), F.col(text_col).alias("_text"))
    gone = decontaminate(keyed, benchmark, "_key", "_text").where("contaminated").select("_key").distinct()
    gone = materialize(gone, "contaminated")
    return docs.join(small(gone), text_key(text_col) == gone["_key"], "left_anti")
