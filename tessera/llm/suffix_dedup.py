"""Operator 6, removal of repeated byte strings by column-wise construction of the suffix order.

Inserting one symbol of every document a round into the suffix order of a whole collection takes as many rounds as the
longest document has bytes, each a pass over everything inserted so far. Here the collection is first cut into buckets in
which all suffixes that matter are aligned, so that a round costs the bucket's rows and there are 336 rounds:

1. Anchors. Of every window of ``SPAN`` bytes the k-gram of least hash is an anchor. Equal windows have the same anchor at
   the same place, so a repeated string shares an anchor with its other occurrence. Anchors that occur once go.
2. Contexts. All windows around an anchor lie in its context of ``SPAN - GRAM`` bytes before and ``SPAN`` from it on. A
   context (by hash) that occurs twice is repeated as a whole. Only anchors with contexts that differ need more.
3. Columns. The contexts of such anchors, aligned at the anchor, are the documents of a bucket. From the last column to the
   first, one symbol of each is inserted: the order of the suffixes (with it the column of the Burrows-Wheeler transform)
   is a stable sort by the inserted symbol, common prefixes with the neighbour are one more than the least between the two
   in the order before. A window is repeated if its suffix shares ``SPAN`` bytes with a neighbour. The symbols are kept in
   a file by columns, read once from end to end.

A bucket of more than ``FITS`` different contexts is split first. All windows that begin in a range of columns share its
core, the bytes from the range's last column to ``SPAN`` after its first; only contexts with equal cores can share such a
window. So each half of the columns makes buckets of its own, by the core, in which equal pieces are repeated as a whole and
count once. Halves are split again while they are too many; a range of one column has the whole window as its core, so that
no two pieces of its buckets differ, and the splitting ends.

Texts are identified by 128 bits of their SHA-256, so equal texts are one, and rows need no id.

Defined results: null texts are empty; texts shorter than ``SPAN`` lose nothing; equal texts of at least that length lose
everything; repeated rows are equal texts; matches never cross documents; other columns, whatever their names, are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.common import discard, map_arrow, materialize, small, text_or_empty

SPAN, GRAM = 200, 64
WIDTH = SPAN - GRAM + 1
#: Bytes before the anchor and in all of a context.
BEFORE = SPAN - GRAM
CONTEXT = BEFORE + SPAN
#: Contexts of a bucket that one task takes; contexts ordered together; cells kept in memory.
FITS, TOGETHER, IN_MEMORY = 4_096, 16_384, 1 << 23
_OUTSIDE = 256
#: Contexts, or stretches, of all texts (20 to 40 bytes each) up to which they are broadcast to the texts.
ENTRIES = 3_000_000


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, K.U64)
    np.cumsum(K._BYTE[data] * K._POW[: len(data)], dtype=K.U64, out=out[1:])
    return out


def _pieces(data: np.ndarray, off: np.ndarray):
    """(row or rows, bytes, offsets, place of the first byte, first and last + 1 start of windows that count)."""
    if len(data) <= K.CHUNK:
        yield data, off, 0, 0, len(data)
        return
    step = K.CHUNK - 4 * CONTEXT
    for a in range(0, len(data) - SPAN + 1, step):
        lo, hi = max(0, a - CONTEXT), min(len(data), a + step + 2 * CONTEXT)
        yield data[lo:hi], np.array([0, hi - lo]), lo, a - lo, min(a + step, len(data)) - lo


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, place in the row, hash of the anchor, hash of its context, for the anchors of all rows."""
    out = []
    for part, edges, shift, first, last in _pieces(data, off):
        n = len(part)
        if n < SPAN:
            continue
        sums = _sums(part)
        h = K.mix((sums[GRAM:] - sums[:-GRAM]) * K._INV[: n - GRAM + 1])
        low = K.window_min(h, WIDTH)
        end = np.repeat(edges[1:], np.diff(edges))
        begin = np.repeat(edges[:-1], np.diff(edges))
        start = np.arange(len(low))
        low[(start + SPAN > end[: len(low)]) | (start < first) | (start >= last)] = 0
        pad = np.zeros(WIDTH - 1, K.U64)
        at = np.flatnonzero((K.window_max(np.concatenate([pad, low, pad]), WIDTH) == h) & (h != 0))
        lo, hi = np.maximum(begin[at], at - BEFORE), np.minimum(end[at], at + SPAN)
        context = (sums[hi] - sums[lo]) * K._INV[lo]
        context += (at - lo).astype(K.U64) * K._STEP[2] + (hi - at).astype(K.U64) * K._STEP[3]
        row = np.searchsorted(edges, at, "right") - 1
        out.append((row, at - edges[row] + shift, h[at], K.mix(context)))
    if not out:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, K.U64),) * 2
    row, place, h, context = (np.concatenate(x) for x in zip(*out, strict=True))
    if len(out) > 1:  # a long text's pieces overlap
        keep = np.unique(place, return_index=True)[1]
        row, place, h, context = row[keep], place[keep], h[keep], context[keep]
    return row, place, h, context


def _digests(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = [hashlib.sha256(data[a:b].tobytes()).digest()[:16] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(out), dtype=">i8").astype(np.int64).reshape(-1, 2)


def digest_columns(text: Column) -> tuple[Column, Column]:
    """The same 128 bits as two longs."""
    half = lambda i: F.conv(F.substring(F.sha2(text, 256), i, 16), 16, -10).cast("long")
    return half(1), half(17)


def _runs(row: np.ndarray, place: np.ndarray, h: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of one text that have the same anchor and context and are near enough for their contexts to touch, as runs: an
    order of the places, where the runs begin in it, and how many places each has."""
    order = np.lexsort((place, context, h, row))
    near = np.zeros(len(order), bool)
    for x in (row, h, context):
        near[1:] |= x[order][1:] != x[order][:-1]
    near = ~near
    near[:1] = False
    near[1:] &= np.diff(place[order]) <= CONTEXT
    begin = np.flatnonzero(~near)
    return order, begin, np.diff(np.append(begin, len(order)))


def _anchor_rows(batches):
    """A row for each run of places: the first and the last, and their number, up to two. A line that a text repeats makes few
    rows, and of equal texts of a task the first two make them all, since two is as good as many."""
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        for _, _, data, off in K.chunks(batch.column(0)):
            row, place, h, context = anchors(data, off)
            if not len(row):
                continue
            names = _digests(data, off)
            keep = np.ones(len(off) - 1, bool)
            for i in np.unique(row).tolist():
                name = (int(names[i, 0]), int(names[i, 1]))
                seen[name] = seen.get(name, 0) + 1
                keep[i] = seen[name] <= 2
            row, place, h, context = (x[keep[row]] for x in (row, place, h, context))
            if not len(row):
                continue
            order, begin, size = _runs(row, place, h, context)
            first, last = order[begin], order[begin + size - 1]
            d = names[row[first]]
            columns = (h[first].view(np.int64), context[first].view(np.int64), d[:, 0], d[:, 1], place[first].astype(np.int32), place[last].astype(np.int32), np.minimum(size, 2).astype(np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "context", "d1", "d2", "place", "last", "n"])


def _anchor_keys(batches):
    for batch in batches:
        for _, _, data, off in K.chunks(batch.column(0)):
            names, n = np.unique(anchors(data, off)[2], return_counts=True)
            if len(names):
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["anchor", "n"])


def _cut(batches):
    """Contexts' bytes: before is the number of bytes before the anchor. Of equal texts of a task one is cut."""
    done = set()
    for batch in batches:
        raw, off = K.column(batch.column(0))
        d1, d2 = batch.column(1), batch.column(2)
        for i in range(batch.num_rows):
            name = (d1[i].as_py(), d2[i].as_py())
            if name in done:
                continue
            done.add(name)
            text = raw[off[i] : off[i + 1]]
            anchor, context, place = (batch.column(k)[i].values for k in (3, 4, 5))
            n, at = len(place), place.to_numpy()
            before = np.minimum(at, BEFORE)
            cut = [text[p - b : p + SPAN].tobytes() for p, b in zip(at.tolist(), before.tolist(), strict=True)]
            same = lambda v: pa.array(np.full(n, v.as_py(), np.int64))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([anchor, context, same(d1[i]), same(d2[i]), place, pa.array(before.astype(np.int32)), pa.array(cut, pa.binary())], names=["anchor", "context", "d1", "d2", "place", "before", "bytes"])


class Columns:
    """The contexts' symbols by columns, in memory or, beyond ``IN_MEMORY`` cells, in a file read once from end to end."""

    def __init__(self, before: list[int], texts: list[bytes]) -> None:
        n = len(texts)
        self.file = tempfile.TemporaryFile() if n * CONTEXT > IN_MEMORY else None
        # The last column comes first, as the rounds take them.
        self.cells = np.memmap(self.file, np.uint16, "w+", shape=(CONTEXT, n)) if self.file else np.empty((CONTEXT, n), np.uint16)
        for lo in range(0, n, 1024):
            block = np.full((min(1024, n - lo), CONTEXT), _OUTSIDE, np.uint16)
            for i in range(len(block)):
                t, skip = texts[lo + i], BEFORE - before[lo + i]
                block[i, skip : skip + len(t)] = np.frombuffer(t, np.uint8)
            self.cells[:, lo : lo + len(block)] = block[:, ::-1].T

    def rounds(self):
        for k in range(CONTEXT):
            yield CONTEXT - 1 - k, self.cells[k]

    def close(self) -> None:
        del self.cells
        if self.file:
            self.file.close()


def repeated_windows(bucket: np.ndarray, before: list[int], texts: list[bytes]) -> np.ndarray:
    """[contexts, WIDTH]: whether the window that begins in that column occurs in another context of the bucket. The
    contexts come in order of their buckets."""
    n = len(texts)
    marks = np.zeros((n, WIDTH), bool)
    columns = Columns(before, texts)
    order, common = np.arange(n), np.zeros(n + 1, np.int32)
    for column, symbols in columns.rounds():
        symbol = np.asarray(symbols)[order].astype(np.int64)
        # The order stays one of buckets, so bucket and symbol together are the sorting key.
        key = bucket[order] * (_OUTSIDE + 1) + symbol
        moved = np.argsort(key, kind="stable")
        key, order = key[moved], order[moved]
        same = np.zeros(n + 1, bool)
        same[1:n] = (key[1:] == key[:-1]) & (symbol[moved][1:] != _OUTSIDE)
        least = np.zeros(n + 1, np.int32)
        here, prior = moved[1:], moved[:-1]
        near = same[1:n] & (here == prior + 1)
        least[1:n][near] = common[:n][here[near]]
        far = np.flatnonzero(same[1:n] & ~near)
        if len(far):
            cuts = np.stack([prior[far] + 1, here[far] + 1], axis=1).ravel()
            least[1:n][far] = np.minimum.reduceat(common, cuts)[::2]
        common = np.where(same, least + 1, 0).astype(np.int32)
        if column < WIDTH:
            hit = (common[:n] >= SPAN) | (common[1:] >= SPAN)
            marks[order[hit], column] = True
    columns.close()
    return marks


def _resolved(batches):
    """Repeated stretches of the contexts, which come in order of anchor and context; each context counts once."""
    held: dict[str, list] = {"anchor": [], "d1": [], "d2": [], "place": [], "before": [], "bytes": []}
    last = None

    def done():
        bucket = np.unique(np.array(held["anchor"], np.int64), return_inverse=True)[1]
        order = np.argsort(bucket, kind="stable")
        marks = repeated_windows(bucket[order], [held["before"][i] for i in order], [held["bytes"][i] for i in order])
        hit = np.flatnonzero(marks.any(axis=1))
        first, final = marks[hit].argmax(axis=1), WIDTH - 1 - marks[hit][:, ::-1].argmax(axis=1)
        at = order[hit]
        place = np.array(held["place"], np.int64)[at] - BEFORE
        out = pa.RecordBatch.from_arrays([pa.array(np.array(held["d1"], np.int64)[at]), pa.array(np.array(held["d2"], np.int64)[at]), pa.array((place + first).astype(np.int32)), pa.array((place + final + SPAN).astype(np.int32))], names=["d1", "d2", "start", "stop"])
        for v in held.values():
            v.clear()
        return out

    for batch in batches:
        rows = batch.to_pydict()
        for i in range(batch.num_rows):
            key = (rows["anchor"][i], rows["context"][i])
            if key == last:
                continue
            if len(held["anchor"]) >= TOGETHER and last[0] != key[0]:
                yield done()
            last = key
            for name, v in held.items():
                v.append(rows[name][i])
    if held["anchor"]:
        yield done()


def _name(*parts: bytes) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(len(p).to_bytes(4, "little") + p)
    return int.from_bytes(h.digest(), "little", signed=True)


_PIECE = "anchor long, context long, d1 long, d2 long, place int, before int, bytes binary"
_SPLIT = f"{_PIECE}, low int, high int, start int, stop int"


def _split(batches):
    """Each piece, whose windows begin in the columns from low to high, as one or two pieces of half the columns; their bucket
    (anchor) is named by the old one and the core, the piece itself (context) by its bytes. start and stop are the text's
    stretch of the piece's windows."""
    for batch in batches:
        rows, out = batch.to_pydict(), []
        for i in range(batch.num_rows):
            t, first, place = rows["bytes"][i], BEFORE - rows["before"][i], rows["place"][i]
            low, high = rows["low"][i], rows["high"][i]
            mid = (low + high + 1) // 2
            for a, b in ((low, mid), (mid, high)):
                begin, end = max(a, first), min(b - 1, first + len(t) - SPAN)  # the first and last window inside the text
                if begin > end or a >= b:
                    continue
                piece = t[begin - first : end + SPAN - first]
                core = t[b - 1 - first : a + SPAN - first]
                sides = f"{a} {b}".encode()
                bucket = _name(rows["anchor"][i].to_bytes(8, "little", signed=True), sides, core)
                out.append((bucket, _name(begin.to_bytes(2, "little"), piece), rows["d1"][i], rows["d2"][i], place, BEFORE - begin, piece, a, b, place - BEFORE + begin, place - BEFORE + end + SPAN))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "context", "d1", "d2", "place", "before", "bytes", "low", "high", "start", "stop"])


def _fitting(pieces: DataFrame, fits: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pieces in buckets of at most ``fits`` different ones, and the stretches that the splitting itself has found."""
    ready, found = [], []
    pieces = pieces.withColumns({"low": F.lit(0), "high": F.lit(WIDTH)})
    while True:
        many = pieces.groupBy("anchor").agg(F.count_distinct("context").alias("different")).where(F.col("different") > fits).select("anchor")
        many = materialize(many, "large-buckets")
        if many.isEmpty():
            ready.append(pieces)
            break
        ready.append(pieces.join(small(many), "anchor", "left_anti"))
        large = pieces.join(small(many), "anchor", "left_semi")
        large = large if found else large.dropDuplicates(["anchor", "context"])  # equal texts of several tasks
        split = materialize(large.transform(map_arrow, _split, _SPLIT), "split-pieces")
        groups = split.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("d1", "d2", "place")).alias("at"))
        groups = materialize(groups, "split-groups")
        twice = groups.where("n > 1").select("anchor", "context")
        found.append(split.join(small(twice), ["anchor", "context"], "left_semi").select("d1", "d2", "start", "stop"))
        others = groups.groupBy("anchor").agg(F.count("*").alias("different")).where("different > 1").select("anchor")
        kept = groups.join(others, "anchor", "left_semi").select("anchor", "context", "at.*")
        pieces = split.join(kept, ["anchor", "context", "d1", "d2", "place"], "left_semi").drop("start", "stop")
        pieces = materialize(pieces, "pieces")
    out = ready[0]
    for r in ready[1:]:
        out = out.unionByName(r)
    return out.drop("low", "high"), found


def _united(batches):
    """Each text's marks as its few maximal stretches."""
    pair = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    for batch in batches:
        out = []
        for marks in batch.column(2):
            runs: list[list[int]] = []
            for a, b in sorted((m["start"], m["stop"]) for m in marks.as_py()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            out.append([{"start": a, "stop": b} for a, b in runs])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pair))], names=["d1", "d2", "marks"])


_MARKS = "marks array<struct<start:int,stop:int>>"


def _removed(batches):
    """The kept bytes and the maximal removed stretches."""
    pair = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    for batch in batches:
        raw, off = K.column(batch.column(1))
        spans, kept, size = [], [], 0
        ids, lo = batch.column(0), 0
        for i, marks in enumerate(batch.column(2)):
            text = raw[off[i] : off[i + 1]]
            own = marks.as_py()
            # A context at the end of a text reaches beyond it.
            runs = [(m["start"], min(m["stop"], len(text))) for m in own or ()]
            left, at = [], 0
            for a, b in runs:
                left.append(text[at:a])
                at = b
            left.append(text[at:])
            kept.append(b"".join(x.tobytes() for x in left))
            spans.append([{"start": a, "stop": b} for a, b in runs])
            size += len(kept[-1])
            if size > 4 * K.CHUNK or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([ids.slice(lo, i + 1 - lo), pa.array(np.diff(off)[lo : i + 1]), pa.array(spans, pa.list_(pair)), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])
                spans, kept, size, lo = [], [], 0, i + 1


def repeats(texts: DataFrame, fits: int = FITS) -> DataFrame:
    """d1, d2, marks (array of start, stop) for every distinct text that has repeated stretches; ``texts`` has one column."""
    name = texts.columns[0]
    keys = texts.transform(map_arrow, _anchor_keys, "anchor long, n byte").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    # Written, so that both sides of the join are exchanged for it and a hot anchor's rows can be split.
    keys = materialize(keys, "repeated-anchors")
    places = texts.transform(map_arrow, _anchor_rows, "anchor long, context long, d1 long, d2 long, place int, last int, n byte")
    places = materialize(places.join(keys, "anchor", "left_semi"), "anchors")
    contexts = places.groupBy("anchor", "context").agg(F.sum("n").alias("n"), F.min(F.struct("d1", "d2", "place")).alias("at"))
    contexts = materialize(contexts, "contexts")
    whole = places.join(contexts.where("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi")
    whole = whole.select("d1", "d2", F.greatest(F.col("place") - BEFORE, F.lit(0)).alias("start"), (F.col("last") + SPAN).alias("stop"))
    mixed = contexts.groupBy("anchor").agg(F.count("*").alias("different"), F.min("n").alias("least")).where("different > 1 and least = 1").select("anchor", "different")
    open_ = contexts.select("anchor", "context", "at.*").join(mixed, "anchor")
    wanted = open_.groupBy(F.col("d1").alias("w1"), F.col("d2").alias("w2")).agg(F.collect_list(F.struct("anchor", "context", "place")).alias("wanted"))
    wanted = materialize(wanted.select("w1", "w2", *[F.col(f"wanted.{c}").alias(f"{c}s") for c in ("anchor", "context", "place")]), "wanted")
    d1, d2 = digest_columns(F.col(name))
    named = texts.select(name, d1.alias("d1"), d2.alias("d2"))
    entries = wanted.agg(F.sum(F.size("places"))).first()[0] or 0
    cut = named.join(small(wanted, entries, ENTRIES), (F.col("d1") == F.col("w1")) & (F.col("d2") == F.col("w2"))).select(name, "d1", "d2", "anchors", "contexts", "places")
    cut = materialize(cut.transform(map_arrow, _cut, _PIECE), "context-bytes")
    pieces, found = _fitting(cut, fits)
    ordered = pieces.repartition("anchor").sortWithinPartitions("anchor", "context")
    marks = whole.unionByName(ordered.transform(map_arrow, _resolved, "d1 long, d2 long, start int, stop int"))
    for f in found:
        marks = marks.unionByName(f)
    marks = marks.distinct()
    marks = marks.groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    marks = materialize(marks.transform(map_arrow, _united, f"d1 long, d2 long, {_MARKS}"), "marks")
    discard(keys, places, contexts, wanted, cut)
    return marks


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, spans (start, stop of the removed stretches, in bytes) and kept (the rest) for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    marks = repeats(rows.select("text")).withColumnsRenamed({"d1": "m1", "d2": "m2"})
    d1, d2 = digest_columns(F.col("text"))
    entries = marks.agg(F.sum(F.size("marks"))).first()[0] or 0
    joined = rows.withColumns({"d1": d1, "d2": d2}).join(small(marks, entries, ENTRIES), (F.col("d1") == F.col("m1")) & (F.col("d2") == F.col("m2")), "left")
    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.select("id", "text", "marks").transform(map_arrow, _removed, f"id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
