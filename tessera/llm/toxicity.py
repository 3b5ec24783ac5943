"""Operator 4, toxicity by weak supervision.

Voters are lexicon entries and patterns: the fixed lexicon below, whole words and word beginnings that are over-represented
in documents labelled toxic, and patterns of shouting, punctuation, address and disguised spelling. A generative label
model (class-conditional firing rates and correlations of the voters, fitted by expectation-maximisation together with the
noise of the given labels) yields posterior labels; voters that fire together within a class are discounted for it. A linear
classifier is trained on the posterior labels and scores whole texts.

The fit takes at most ``FIT_ROWS`` labelled documents of each label, those with the least hash of their id, and keeps at
most ``VOTERS`` voters; everything that reaches the driver is bounded by these two. Scoring reads every text whole.

Defined results: null and empty texts are scored (by the intercept); without any labelled document, or with one label
only, the score is the constant share of toxic labels (0 if there is none); rows with a null id are never learnt from;
repeated rows get equal scores; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.common import map_arrow, materialize, text_or_empty
from tessera.llm.language_id import fold

FIT_ROWS, VOTERS, SUPPORT, LIFT = 4096, 256, 3, 3.0
#: Lengths in bytes of the word beginnings that can vote; 0 is the whole word.
LENGTHS = (0, 4, 5, 6, 7, 8)

# Insults.
LEXICON = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "dumbass", "imbecile", "loser", "losers", "trash", "garbage", "scum", "scumbag", "filth", "vermin", "worthless", "pathetic", "disgusting", "clown", "fool", "jerk", "bastard", "bitch", "asshole", "crap", "damn", "hate", "kill", "ugly", "retard", "retarded", "freak", "creep", "coward", "liar", "shut", "sucks", "screw", "hell")
PATTERNS = ("shouting", "exclaiming", "second_person", "disguised")
#: Numbers besides the votes: the patterns, log of 1 + words that any voter hits, and their share of the words.
DENSE = len(PATTERNS) + 2
# Signs that stand for letters in disguised spelling.
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_PLAIN = K.SAME.copy()
for _sign, _letter in _SIGNS.items():
    _PLAIN[ord(_sign)] = ord(_letter)
_DISGUISE = K.LETTER.copy()
_DISGUISE[[ord(c) for c in _SIGNS]] = True
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_BANG = np.arange(256) == ord("!")


def _hashes(text: K.Starts, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' beginnings of that length, and which words are long enough."""
    if not length:
        return text.hashes(starts, ends), np.arange(len(starts))
    long = np.flatnonzero(ends - starts >= length)
    return text.hashes(starts[long], starts[long] + length) + K.U64(length), long


def _of_words(words: tuple[str, ...]) -> np.ndarray:
    data, off = K.column(pa.array(words))
    return K.span_hashes(data, off[:-1], off[1:], K.SAME)


def _mine(batches):
    """(feature, n_toxic, n) over the documents of a task; a feature counts once a document."""
    seen: list[np.ndarray] = []
    marks: list[np.ndarray] = []

    def rows():
        f, t = np.concatenate(seen), np.concatenate(marks)
        names, which = np.unique(f, return_inverse=True)
        n, n_toxic = np.bincount(which), np.bincount(which, weights=t)
        seen.clear()
        marks.clear()
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n_toxic.astype(np.int64)), pa.array(n.astype(np.int64))], names=["feature", "n_toxic", "n"])

    held = 0
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, off in K.chunks(batch.column(1)):
            low = fold(data)
            starts, ends, first = K.words(low, off, K.LETTER)
            if not len(starts):
                continue
            row, text = np.repeat(np.arange(hi - lo), np.diff(first)), K.Starts(low)
            for length in LENGTHS:
                h, which = _hashes(text, starts, ends, length)
                key = np.stack([row[which].astype(K.U64), h])
                order = np.lexsort(key[::-1])
                key = key[:, order]
                new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])[: key.shape[1]]
                seen.append(key[1][new])
                marks.append(toxic[lo:hi][key[0][new].astype(np.int64)].astype(np.float64))
                held += len(seen[-1])
            if held > 4_000_000:
                yield rows()
                held = 0
    if seen:
        yield rows()


def _features(col: pa.Array, table: dict) -> tuple[np.ndarray, np.ndarray]:
    """Votes [rows, voters] and numbers [rows, DENSE] of whole texts."""
    n = len(col)
    votes, patterns = np.zeros((n, table["voters"]), bool), np.zeros((n, DENSE))
    for lo, hi, data, off in K.chunks(col):
        if not len(data):
            continue
        low = fold(data)
        starts, ends, first = K.words(low, off, K.LETTER)
        row = np.repeat(np.arange(lo, hi), np.diff(first))
        struck, text = np.zeros(len(starts), bool), K.Starts(low)
        for length, (known, number) in table["by_length"].items():
            h, which = _hashes(text, starts, ends, length)
            if len(h) and len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[at] == h)
                votes[row[which[hit]], number[at[hit]]] = True
                struck[which[hit]] = True
        size = np.maximum(np.diff(off), 1)
        sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[data])])[off])
        upper, bangs, letters = sums(_UPPER), sums(_BANG), sums(K.LETTER)
        patterns[lo:hi, 0] = upper > 0.5 * np.maximum(letters, 1)
        patterns[lo:hi, 1] = bangs > 0.01 * size
        if len(starts):
            hits = np.bincount(row - lo, weights=struck, minlength=hi - lo)
            patterns[lo:hi, -2] = np.log1p(hits)
            patterns[lo:hi, -1] = np.minimum(1, 20 * hits / np.maximum(np.diff(first), 1))
            you = np.isin(text.hashes(starts, ends), table["you"])
            patterns[lo:hi, 2] = np.bincount(row - lo, weights=you, minlength=hi - lo) > 0.02 * np.maximum(np.diff(first), 1)
        # Words with a sign in the place of a letter, read as if it were the letter.
        s2, e2, f2 = K.words(data, off, _DISGUISE)
        if len(s2):
            odd = np.concatenate([[0], np.cumsum(_DISGUISE[data] & ~K.LETTER[data])])
            plain = np.concatenate([[0], np.cumsum(K.LETTER[data])])
            mixed = np.flatnonzero((odd[e2] > odd[s2]) & (plain[e2] > plain[s2]))
            if len(mixed):
                found = np.isin(K.span_hashes(_PLAIN[low], s2[mixed], e2[mixed], K.SAME), table["lexicon"])
                rows = np.repeat(np.arange(hi - lo), np.diff(f2))[mixed]
                patterns[lo:hi, 3] = np.bincount(rows, weights=found, minlength=hi - lo) > 0
    return votes, patterns


def _votes(shared):
    def run(batches):
        for batch in batches:
            votes, dense = _features(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in np.packbits(votes, axis=1)], pa.binary()), pa.array([r.tolist() for r in dense], pa.list_(pa.float64()))], names=["toxic", "votes", "dense"])

    return run


def label_model(votes: np.ndarray, gold: np.ndarray, weight: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """Posterior of the toxic class for each row, and the model: firing rates by class, trust in the given labels, the voters'
    correlations within the classes and each voter's discount for them. Everything is estimated anew in every round, from
    the posterior of the round before and with the rows' weights."""
    share = np.average(gold, weights=weight)
    post = np.where(gold > 0, 0.95, 0.05 * share + 1e-6)
    v = votes.astype(np.float64)
    discount = np.ones(v.shape[1])
    rates, trust, together = np.zeros((2, v.shape[1])), np.zeros(2), np.eye(v.shape[1])
    for k in range(rounds):
        for c, p in enumerate((1 - post, post)):
            w = weight * p
            rates[c] = (w @ v + 0.1 * weight.mean()) / (w.sum() + weight.mean())
            trust[c] = np.clip((w @ gold + weight.mean() * share) / (w.sum() + weight.mean()), 1e-3, 1 - 1e-3)
        if k:  # the first posterior is a guess
            together = _correlations(v, post, rates, weight)
            discount = 1 / np.maximum(1, together.sum(axis=1))
        prior = np.clip(np.average(post, weights=weight), 1e-4, 1 - 1e-4)
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
        fire, quiet = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        odds = np.log(prior / (1 - prior)) + (v * (fire - quiet) + quiet) @ discount
        odds += np.where(gold > 0, np.log(trust[1] / trust[0]), np.log((1 - trust[1]) / (1 - trust[0])))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, {"rates": rates, "trust": trust, "correlations": together, "discount": discount, "prior": prior}


def _correlations(v: np.ndarray, post: np.ndarray, rates: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positive correlations of the voters' residuals within the classes; 1 on the diagonal."""
    rest = v - (post[:, None] * rates[1] + (1 - post[:, None]) * rates[0])
    cov = (rest * weight[:, None]).T @ rest / weight.sum()
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    out = np.clip(cov / sd[:, None] / sd[None, :], 0, 1)
    np.fill_diagonal(out, 1.0)
    out[out < 0.1] = 0
    return out


def linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Weights (the last one is the intercept) of a logistic regression on soft targets, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    weight = weight / weight.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + penalty * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _table(chosen: list[tuple[int, int]]) -> dict:
    """Lookup of the voters: for each length, hashes in order and the voters' numbers."""
    by: dict[int, tuple] = {}
    for length in LENGTHS:
        own = [(h, i) for i, (h, k) in enumerate(chosen) if k in (length, -1)]
        h = np.array([x[0] for x in own], K.U64)
        order = np.argsort(h)
        by[length] = h[order], np.array([x[1] for x in own], np.int64)[order]
    return {"voters": len(chosen), "by_length": by, "you": np.sort(_of_words(("you", "your", "yourself"))), "lexicon": np.sort(_of_words(LEXICON))}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> dict:
    """The model, from the rows of ``labels``, all of which may be learnt from."""
    spark = docs.sparkSession
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    given = materialize(given.where(F.col("toxic").isin(0, 1)), "toxic-labels")
    total = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return {"constant": 1.0 if 1 in total else 0.0}
    parts = [given.where(F.col("toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows) for c in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(sample, "_id")
    rows = materialize(rows.select("toxic", "_text"), "toxic-sample")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return {"constant": 1.0 if 1 in n else 0.0}
    mined = rows.transform(map_arrow, _mine, "feature long, n_toxic long, n long").groupBy("feature").agg(F.sum("n_toxic").alias("a"), (F.sum("n") - F.sum("n_toxic")).alias("b"))
    p1, p0, every = F.col("a") / n[1], F.col("b") / n[0], F.lit(n[0] + n[1])
    pooled = (F.col("a") + F.col("b")) / every
    z = (p1 - p0) / F.sqrt(pooled * (F.lit(1.0) - pooled) * (1 / n[0] + 1 / n[1]) + 1e-12)
    mined = mined.where((F.col("a") >= SUPPORT) & (p1 >= LIFT * p0)).orderBy(z.desc(), "feature").limit(4 * VOTERS).collect()
    chosen: list[tuple[int, int]] = [(int(h), 0) for h in _of_words(LEXICON)]
    known, alike = {h for h, _ in chosen}, set()
    for r in mined:  # a word and its beginning that are in the same documents count once
        h = r["feature"] % (1 << 64)
        if h not in known and (r["a"], r["b"]) not in alike and len(chosen) < VOTERS:
            alike.add((r["a"], r["b"]))
            chosen.append((h, -1))
    table = _table(chosen)
    shared = spark.sparkContext.broadcast(table)
    got = rows.transform(map_arrow, _votes(shared), "toxic int, votes binary, dense array<double>").collect()
    got.sort(key=lambda r: (r["toxic"], bytes(r["votes"]), r["dense"]))
    votes = np.unpackbits(np.frombuffer(b"".join(bytes(r["votes"]) for r in got), np.uint8).reshape(len(got), -1), axis=1)[:, : len(chosen)].astype(bool)
    dense = np.array([r["dense"] for r in got])
    gold = np.array([r["toxic"] for r in got], float)
    weight = np.where(gold > 0, total[1] / n[1], total[0] / n[0])
    post, labeller = label_model(np.concatenate([votes, dense[:, : len(PATTERNS)] > 0], axis=1), gold, weight)
    # The voters' joint log odds, after the discounts, are a feature of their own.
    rates, discount = np.clip(labeller["rates"], 1e-4, 1 - 1e-4), labeller["discount"]
    fire = (np.log(rates[1] / rates[0]) - np.log((1 - rates[1]) / (1 - rates[0]))) * discount
    model = table | {"labeller": labeller, "fire": fire[: len(chosen)]}
    return model | {"linear": linear(_inputs(votes, dense, model), post, weight)}


def _inputs(votes: np.ndarray, dense: np.ndarray, model: dict) -> np.ndarray:
    odds = votes @ np.maximum(model["fire"], 0)
    return np.concatenate([votes, dense, np.minimum(odds, 20)[:, None] / 5], axis=1)


def _scores(texts: pa.Array, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), float(model["constant"]))
    x, w = _inputs(*_features(texts, model), model), model["linear"]
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for lo, hi, _, _ in K.chunks(batch.column(1), 16 * K.CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(_scores(batch.column(1).slice(lo, hi - lo), model))], names=["id", "score"])

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col)).transform(map_arrow, _score(shared), f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: dict, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score ``limit`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(place), shared.value) < limit))

    return docs.transform(map_arrow, run, docs.schema)
