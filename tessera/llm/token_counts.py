"""Operator 1, token counts through a digest cache.

The normalised content of a document is its text with null as the empty text: byte-level tokenizers see every byte, so
any further normalisation would change counts. A document's key is the SHA-256 of that content; a cache row is
(content digest, tokenizer digest, n_tokens), the tokenizer digest being taken over the tokenizer's file, the library's
version and the settings. ``count_tokens`` joins the documents' digests to the cache, encodes one text of each digest that
has no row, appends the new rows and joins the counts back. Texts move at most once, and only those to be encoded.

Defined results: null or empty text -> 0 bytes, 0 tokens; repeated rows and equal texts -> the same count from one
encoding; null ids pass through; an empty table -> no rows; other columns, whatever their names, are not read; a text of
any length is encoded whole, in pieces cut where the tokenizer's own pre-tokenizer cuts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import scratch
from tessera.llm.common import discard, map_arrow, materialize, small, text_or_empty

OVER_LIMIT = 512
#: The setting that names the cache's folder.
CACHE = "spark.tessera.token.cache"
#: Characters of texts encoded at a time, counts of chunks remembered by a worker, longest chunk remembered.
PIECE, MEMO, MEMO_CHARS = 1 << 20, 400_000, 64

#: Runs of white space on which Python and the tokenizers' regular expressions agree, with what follows up to the next.
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*(?:\S|[\x1c-\x1f])+|[^\S\x1c-\x1f]+")
_CUT = re.compile(r"(?:\S|[\x1c-\x1f])(?=[^\S\x1c-\x1f])")


class Encoder:
    """Counts as ``encode_batch(texts, add_special_tokens=False)`` gives them.

    A byte-level pre-tokenizer with its own regular expression never lets a token cross from a non-space to a space, so
    the count of a text is the sum of the counts of its space-led chunks, and counts of short chunks are remembered.
    Any other tokenizer encodes whole texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = all(not (a["lstrip"] or a["rstrip"] or a["normalized"] or re.search(r"\s", a["content"])) for a in added)
        self.by_chunk = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None and plain
        self.memo: dict[str, int] = {}

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_chunk:
            return self._encoded(texts)
        return [self._long(texts[0])] if len(texts) == 1 and len(texts[0]) > PIECE else self._batch(texts)

    def _long(self, text: str) -> int:
        total = at = 0
        while at < len(text):
            cut = _CUT.search(text, at + PIECE)
            end = cut.end() if cut else len(text)
            total += self._batch([text[at:end]])[0]
            at = end
        return total

    def _batch(self, texts: list[str]) -> list[int]:
        split = [_CHUNK.findall(t) for t in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = list(set().union(*split) - memo.keys())
        known = dict(zip(new, self._encoded(new), strict=True)) if new else {}
        memo.update(known)
        out = [sum(map(memo.__getitem__, s)) for s in split]
        for c in known:
            if len(c) > MEMO_CHARS:
                del memo[c]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_digest(path: str) -> str:
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|tokenizers {tokenizers.__version__}|no special tokens added".encode()).hexdigest()


def _encode(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            digests, counts, group, size = batch.column(0), [], [], 0
            for text in batch.column(1):
                t = text.as_py() or ""
                if group and size + len(t) > PIECE:
                    counts += enc.counts(group)
                    group, size = [], 0
                group.append(t)
                size += len(t)
            if group:
                counts += enc.counts(group)
            yield pa.RecordBatch.from_arrays([digests, pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = OVER_LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row of ``docs``. ``tokenizer`` is the path of a tokenizer file that
    every executor can read, ``cache`` the folder of the cache in a store that all share: that of the session's setting
    ``CACHE`` unless named here, where later jobs find it again; a new one, for this call alone, without either."""
    spark = docs.sparkSession
    cache = cache or spark.conf.get(CACHE, None) or scratch.scratch_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    keyed = materialize(rows.select("_id", "digest", F.octet_length("_text").cast("long").alias("n_bytes")), "token-keys")
    new = keyed.groupBy("digest").agg(F.min("_id").alias("_first"))
    known = _cached(spark, cache, version)
    if known is not None:
        new = new.join(known.select("digest"), "digest", "left_anti")
    new = materialize(new, "token-misses")
    missing = new.count()
    if missing:
        mark = small(new.select(F.col("digest").alias("_d"), "_first"), missing)
        texts = rows.join(mark, (F.col("digest") == F.col("_d")) & F.col("_id").eqNullSafe(F.col("_first")), "left_semi")
        counted = texts.select("digest", "_text").transform(map_arrow, _encode(tokenizer), "digest binary, n_tokens long")
        counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        counted.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache)
    discard(new)
    known = _cached(spark, cache, version)
    out = keyed.join(known, "digest", "left") if known is not None else keyed.withColumn("n_tokens", F.lit(0).cast("long"))
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cached(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    if not scratch.exists(spark, cache):
        return None
    table = spark.read.schema("digest binary, n_tokens long, tokenizer string").parquet(cache)
    # Two runs that miss at the same time append the same row twice.
    return table.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
