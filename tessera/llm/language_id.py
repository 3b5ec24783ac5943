"""Operator 10, language identification of spans.

Training counts hashed byte trigrams (with word boundaries) and scripts of every word of all training texts, by language.
A word's score for a language is the log probability of its trigrams; the script ranges of its letters (ranges of code
points; of several, the one that comes later in ``SCRIPT_NAMES``) leave only the languages that were seen in that script. Viterbi over a text's words, with a penalty for each switch, labels spans; the
language of most labelled bytes is the text's, and its share of them the score.

The model has ``BUCKETS`` counts a language, whatever the input's size, so it is broadcast. Texts of a group step through
Viterbi together; a text of any length is labelled whole.

Defined results: null, empty and letterless texts -> ``und`` with score 0 and no spans; training rows with a null id, text
or language teach nothing; with nothing learnt every text is ``und``; an empty table gives no rows; ties go to the language that sorts first; repeated
rows get equal rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.common import map_arrow, text_or_empty

BUCKETS = 1 << 15
#: Nats that a switch of language costs; added to every count; share of a language's words from which a script is its own.
SWITCH, SMOOTH, SCRIPT_SHARE = 20.0, 0.5, 0.005
#: Bytes of text whose words step through Viterbi together, for four languages.
GROUP = 16 << 20

# The first code points of ranges of scripts, each up to the next.
_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"), (0x0800, "other"), (0x0860, "Syriac"), (0x0870, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "other"),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x2D00, "Georgian"), (0x2D30, "other"), (0x2D80, "Ethiopic"), (0x2DE0, "Cyrillic"), (0x2E00, "Latin"), (0x2E80, "Han"), (0x3000, "Latin"),
    (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "other"), (0xA640, "Cyrillic"), (0xA6A0, "other"), (0xA700, "Latin"), (0xA800, "other"), (0xA8E0, "Devanagari"), (0xA900, "other"), (0xA960, "Hangul"),
    (0xA980, "other"), (0xAB30, "Latin"), (0xAB70, "other"), (0xAC00, "Hangul"), (0xD800, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Latin"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, "other"), (0x1B000, "Kana"), (0x1B170, "other"), (0x20000, "Han"), (0x32000, "other"),
)
#: Latin, marks and signs that every script uses come first.
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in _RANGES))
SCRIPTS = len(SCRIPT_NAMES)
_FIRST = np.array([first for first, _ in _RANGES])
_SCRIPT = np.array([SCRIPT_NAMES.index(name) for _, name in _RANGES], np.uint8)


def scripts(data: np.ndarray) -> np.ndarray:
    """The script of every character, at its first byte; Latin's number, the least, at all others."""
    out = np.zeros(len(data), np.uint8)
    far = np.flatnonzero(data >= 0xC3)  # two bytes up to U+00BF are signs
    if not len(far):
        return out
    lead = data[far].astype(np.int32)
    next_ = lambda k: data[np.minimum(far + k, len(data) - 1)].astype(np.int32) & 0x3F
    two = (lead & 0x1F) << 6 | next_(1)
    three = (lead & 0x0F) << 12 | next_(1) << 6 | next_(2)
    four = (lead & 0x07) << 18 | next_(1) << 12 | next_(2) << 6 | next_(3)
    point = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    out[far] = _SCRIPT[np.searchsorted(_FIRST, point, "right") - 1]
    return out


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 lowered."""
    out = K.LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[capital] += 0x20
    return out


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around every byte of a word, where each word's begin, and each word's script."""
    size = ends - starts
    begin = np.cumsum(size) - size
    at = K.ranges(starts, size)
    low = fold(data)
    mid = low[at].astype(np.uint32)
    left, right = np.zeros_like(mid), np.zeros_like(mid)
    left[1:], right[:-1] = mid[:-1], mid[1:]
    left[begin] = 0
    right[begin + size - 1] = 0
    code = ((left << np.uint32(16)) | (mid << np.uint32(8)) | right) * np.uint32(0x9E3779B1)
    script = np.maximum.reduceat(scripts(data)[at], begin) if len(begin) else np.zeros(0, np.uint8)
    return (code >> np.uint32(17)).astype(np.int32), begin, script


def _count(batches):
    """(lang, bucket, n); buckets from ``BUCKETS`` on count the words of each script."""
    total: dict[str, np.ndarray] = {}

    def rows():
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])
        total.clear()

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for lo, hi, data, off in K.chunks(batch.column(1)):
            starts, ends, first = K.words(data, off, K.LETTER)
            if not len(starts):
                continue
            bucket, begin, script = _grams(data, starts, ends)
            edge = np.append(begin, len(bucket))[first]
            own = langs[lo:hi]
            for lang in sorted(set(own)):
                rows_of = np.flatnonzero(own == lang)
                byte = K.ranges(edge[rows_of], edge[rows_of + 1] - edge[rows_of])
                word = K.ranges(first[rows_of], first[rows_of + 1] - first[rows_of])
                n = total.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, np.int64))
                n[:BUCKETS] += np.bincount(bucket[byte], minlength=BUCKETS)
                n[BUCKETS:] += np.bincount(script[word], minlength=SCRIPTS)
            if len(total) > 200:
                yield from rows()
    yield from rows()


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict:
    """The model: languages in order, log probabilities [BUCKETS, languages], allowed [SCRIPTS, languages]."""
    seen = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string"))
    counts = seen.transform(map_arrow, _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts["lang"].to_pylist()))
    place = {x: i for i, x in enumerate(names)}
    n = np.zeros((BUCKETS + SCRIPTS, len(names)))
    if names:
        n[counts["bucket"].to_numpy(), [place[x] for x in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
    grams = n[:BUCKETS] + SMOOTH
    words = n[BUCKETS:]
    allowed = words >= SCRIPT_SHARE * np.maximum(words.sum(axis=0, keepdims=True), 1)
    allowed[~allowed.any(axis=1)] = True
    return {"langs": names, "log": np.log(grams / grams.sum(axis=0, keepdims=True)).astype(np.float32) if names else grams.astype(np.float32), "allowed": allowed}


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: dict) -> np.ndarray:
    bucket, begin, script = _grams(data, starts, ends)
    scores = np.add.reduceat(model["log"][bucket], begin, axis=0)
    out = ~model["allowed"][script]
    scores[out] -= np.float32(1e4)
    return scores


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word of all rows; ``first`` has where the words of each row begin, and their end."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    labels = np.zeros(len(scores), np.int16)
    n = int(np.count_nonzero(size))
    if not n:
        return labels
    step = np.float32(switch)
    lanes = np.arange(n)
    active = np.searchsorted(-size[:n], -np.arange(size[0]), "left")  # rows with more than t words
    best = scores[begin[:n]].copy()
    stay: list[np.ndarray] = []
    top: list[np.ndarray] = []
    last = np.zeros(n, np.int64)
    for t in range(1, int(size[0])):
        k = int(active[t])
        if k < n:
            last[k:n] = best[k:n].argmax(axis=1)
            best, n = best[:k], k
        peak = best.argmax(axis=1)
        moved = (best[lanes[:k], peak] - step)[:, None]
        stay.append(best >= moved)
        top.append(peak.astype(np.int16))
        best = np.maximum(best, moved)
        best += scores[begin[:k] + t]
        best -= best.max(axis=1, keepdims=True)
    last[:n] = best.argmax(axis=1)
    # Back through the steps: rows join as their last word comes.
    for t in range(int(size[0]) - 1, -1, -1):
        k = int(active[t])
        labels[begin[:k] + t] = last[:k]
        if t:
            keep = stay[t - 1][lanes[:k], last[:k]]
            last[:k] = np.where(keep, last[:k], top[t - 1][:k])
    return labels


def _label(shared):
    def run(batches):
        model = shared.value
        names = np.array([*model["langs"], "und"], dtype=object)
        langs = len(model["langs"])
        limit = max(K.CHUNK, GROUP * 4 // max(4, langs))
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, data, off in K.chunks(texts, limit):
                n = hi - lo
                starts, ends, first = K.words(data, off, K.LETTER)
                pred, score = np.full(n, langs), np.zeros(n)
                letters = np.add.reduceat(np.append((K.LETTER & (np.arange(256) < 128))[data], False).astype(np.int64), np.minimum(off[:-1], len(data))) * (np.diff(off) > 0) > 0
                for row in np.flatnonzero(~letters & (np.diff(first) > 0)):
                    letters[row] = any(c.isalpha() for c in texts[lo + int(row)].as_py())
                runs_of, begin_at, end_at, label_of = np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if langs and len(starts):
                    scores = np.empty((len(starts), langs), np.float32)
                    a = 0
                    while a < len(starts):
                        b = max(a + 1, int(np.searchsorted(starts, starts[a] + K.CHUNK)))
                        base, stop = int(starts[a]), int(ends[b - 1])
                        scores[a:b] = word_scores(data[base:stop], starts[a:b] - base, ends[a:b] - base, model)
                        a = b
                    labels = viterbi(scores, first, SWITCH)
                    row = np.repeat(np.arange(n), np.diff(first))
                    mass = np.bincount(row * langs + labels, weights=(ends - starts).astype(float), minlength=n * langs).reshape(n, langs)
                    has = letters & (mass.sum(axis=1) > 0)
                    pred[has] = mass[has].argmax(axis=1)
                    score[has] = mass[has].max(axis=1) / mass[has].sum(axis=1)
                    turn = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (labels[1:] != labels[:-1])]) & has[row])
                    stop_at = np.append(turn[1:], len(row)) - 1
                    stop_at = np.minimum(stop_at, first[row[turn] + 1] - 1)
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
                    zero = chars[off[row[turn]]]
                    begin_at, end_at, label_of = chars[starts[turn]] - zero, chars[ends[stop_at]] - zero, labels[turn]
                    runs_of = np.searchsorted(row[turn], np.arange(n + 1))
                spans = pa.StructArray.from_arrays([pa.array(begin_at.astype(np.int64)), pa.array(end_at.astype(np.int64)), pa.array(names[label_of.astype(np.int64)], pa.string())], names=["start", "end", "lang"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(names[pred], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(runs_of.astype(np.int32)), spans)], names=["id", "lang_pred", "score", "spans"])

    return run


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and spans (start, end in code points, lang) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col))
    return rows.transform(map_arrow, _label(shared), f"id {kind}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>").withColumnRenamed("id", id_col)


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))
