"""Operator 9, secret scans.

Three base patterns, and a fourth kind by the guess cost of a password: a value in a credential's context (after a name
and a separator, where Bearer, Basic or Token may come between, or after bearer and white space) is split by
dynamic programming into words, dates, repeats, keyboard walks and brute-force spans so that the product of their guesses
is least; if even that split needs ``GUESSES`` guesses (as a power of ten) the value is a secret. Base spans stay as they
are; a value that one base span covers wholly is not added again, one that reaches beyond it is. A value of any length is
scored whole, in time proportional to its length.

Defined results: null or empty text -> no spans; repeated rows -> equal rows; spans that start together come in the order
of their kinds; an empty table -> no rows; other columns, whatever their names, are not read. Spans are in code points, the
end exclusive.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, text_or_empty

KINDS = ("assign", "access", "hex", "guess")
#: Guesses, as a power of ten, from which a value in a credential's context is a secret.
GUESSES = 10.0

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_NAMES = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|client|auth)[_-]?key|credentials?|bearer|authorization)[\"']?"
# A value of fewer than six characters stays below the limit, whatever they are.
# After a scheme a name with its own separator begins a context, not a value; before, a name alone does not hide its value.
_SCHEME = rf"[\x20\t]+[\"']?(?!{_NAMES}[\x20\t]*(?:[:=]|\x20is\x20))"
_ALONE = rf"(?!{_NAMES}(?:[:=]>?[\x20\t]|[\x20\t]+[:=]|[\x20\t]*\x20is\x20))"
_CONTEXT = re.compile(rf"(?:{_NAMES}[\x20\t]*(?:[:=]>?|\x20is\x20)[\x20\t]*[\"']?(?:(?:bearer|basic|token){_SCHEME})?|bearer{_SCHEME}){_ALONE}([^\s\"',;<>|()\[\]{{}}]{{6,}})", re.I | re.A)
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "authorization")

# Common parts of passwords, most common first.
WORDS = (
    "password", "qwerty", "dragon", "monkey", "letmein", "master", "sunshine", "princess", "football", "baseball", "shadow", "superman", "trustno", "welcome", "login", "admin", "hello", "freedom", "whatever", "flower", "lovely", "secret", "summer", "winter", "spring", "autumn", "love", "pass", "user", "test", "guest", "root", "change", "changeme", "default", "example", "sample", "demo", "token", "key", "api", "foo", "bar", "baz", "your", "here", "the", "and", "for", "you", "with", "none", "null", "true", "false", "string", "value", "hidden", "redacted", "placeholder", "insert", "enter", "correct", "horse", "battery", "staple", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "monday", "friday", "sunday", "money", "house", "computer", "internet", "service", "server", "public", "private", "access", "system", "database", "mysql", "oracle", "michael", "jordan", "thomas", "daniel", "jessica", "charlie",
)
# Endings and common words of prose and settings, so that plain words after a context are cheap.
WORDS += tuple(
    "ing tion ation able ment ness ally ized est ful less ously ity ance ence ers ion ive understand important incorrect required authentic authorize authorization administrator administration configure configuration config credential certificate username account accept according actually address advance against agreement algorithm allowed already alternative always another answer anything application appropriate argument article assign associate attempt attribute automatic available before behavior behaviour believe between business button cannot careful cause certain challenge character check client collect command comment commit common communicate company compare complete component compromise condition confirm connect consider constant contain content context continue control convert correctly could country create current customer declare decrypt delete deliver depend describe description destination determine develop device different difficult digital direct directory disable discover display distribute document domain download during dynamic easily effect element email empty enable encode encrypt encryption endpoint engine ensure entirely environment error especially establish evaluate every everyone everything exactly exchange execute exist expect experience expire explain export express extend extension external extreme failure family feature finally follow forever forget forgotten format forward friend function general generate government granted guarantee happen hardware history however identical identifier identify immediately implement import impossible improve include increase independent individual information initial input instance instead institution instruction integrate integrity intend interest interface internal international invalid issue itself javascript keyboard knowledge language later leaked learn length letter library limit listen local location longer machine maintain manage management manager material matter maximum meaning member memory message method minimum missing mobile modern modify module moment morning mountain multiple national natural necessary network neither never normal nothing notice notification number object obtain obvious office official online operate operation optional order organize organization original other output overview package parameter partner people perform permanent permission personal persist phone physical platform please policy popular position possible practice prepare present prevent previous print priority probably problem process produce product production professional profile program project properly property protect protocol provide purpose quality question random rather reason receive recent recognize recommend record recover reference refresh register regular relation release remain remember remote remove repeat replace report repository represent request require research reserve reset resource response responsible restore restrict result retrieve return revoke safety school science script search section secure security select send sensitive sentence separate sequence session setting several shared should signature similar simple single social software someone something source special specific standard start state statement station storage store strength strong structure student subject submit subscribe success suggest support surface switch symbol sync technical technology temporary terminal therefore thing think thought through together tomorrow traffic transaction transfer transform transport travel truth trust typical unable under unique universal university unknown unless update upload useful usually valid validate variable various verify verification version visible visit warning website weight while whole window without wonder world write written wrong yesterday yourself".split()
)
# Rows of keys and the two alphabets that walks follow.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "0123456789")



def ranked(words: tuple[str, ...]) -> tuple[dict[str, float], int]:
    """log10 of the guesses of each word, the most common first, and the length of the longest."""
    ranks: dict[str, float] = {}
    for w in words:
        ranks.setdefault(w.lower(), math.log10(len(ranks) + 2))
    return ranks, max(map(len, ranks), default=0)


_RANKED = ranked(WORDS)
_NEXT = {(a, b) for row in WALKS for a, b in zip(row, row[1:], strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:[0-2]?\d|3[01])|(?:[0-2]?\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.A)


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33)


class _Starts:
    """Where a repeat or walk that ends here may have begun. Of a start's cost, best[i] + log10(j - i), the second term grows
    ever more slowly, so a start that a smaller one undercuts, or a later one without a greater cost, never is the cheapest
    again: few remain, whatever the length."""

    def __init__(self):
        self.at: list[tuple[int, float]] = []

    def cheapest(self, j: int) -> float:
        """The least best[i] + log10(j - i)."""
        low, kept = math.inf, []
        for i, b in self.at:
            if (cost := b + math.log10(j - i)) < low:
                low = cost
                while kept and kept[-1][1] >= b:
                    kept.pop()
                kept.append((i, b))
        self.at = kept
        return low


def guess_cost(value: str, limit: float = GUESSES, dictionary: tuple[dict[str, float], int] = _RANKED) -> float:
    """log10 of the guesses of the cheapest segmentation. Every word, date, walk of three keys or more and repeat is a segment,
    wherever it begins and ends. A unit of so many characters costs as much, so repeats of units that alone reach the
    ``limit`` are left out: the result is exact below the limit, and not below it where the cost isn't; time is linear for any
    finite limit."""
    ranks, longest = dictionary
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    bulk = [0.0]
    for c in value:
        bulk.append(bulk[-1] + _brute(c))
    two, walk = math.log10(2), math.log10(len(WALKS) * 26 * 2)
    best = [0.0] + [math.inf] * n
    walks = {1: (_Starts(), 0), -1: (_Starts(), 0)}
    units = range(1, int(min(n // 2, math.ceil(limit) - 1 if limit < math.inf else n)) + 1)
    runs = dict.fromkeys(units, 0)
    repeats = {unit: [_Starts() for _ in range(unit)] for unit in units}
    for j in range(n + 1):
        if j:
            best[j] = min(best[j], best[j - 1] + bulk[j] - bulk[j - 1])
        for step, (starts, first) in walks.items() if j > 1 else ():
            if ((low[j - 2], low[j - 1]) if step > 0 else (low[j - 1], low[j - 2])) not in _NEXT:
                walks[step] = (_Starts(), j - 1)
            elif j - 3 >= first:
                starts.at.append((j - 3, best[j - 3]))
                best[j] = min(best[j], starts.cheapest(j) + walk + two)
        for unit in units:
            if j <= unit:
                break
            if value[j - 1] != value[j - 1 - unit]:
                if runs[unit]:
                    runs[unit], repeats[unit] = 0, [_Starts() for _ in range(unit)]
                continue
            runs[unit] += 1
            i = j - max(2 * unit, 3)
            if i >= 0 and runs[unit] >= j - i - unit:
                starts = repeats[unit][j % unit]
                starts.at.append((i, best[i]))
                best[j] = min(best[j], starts.cheapest(j) - math.log10(unit) + bulk[j] - bulk[j - unit] + two)
        for size in range(3, min(longest, n - j) + 1):
            if (word := low[j : j + size]) in ranks:
                cost = ranks[word] + (0.0 if value[j : j + size] == word else math.log10(2 + size))
                best[j + size] = min(best[j + size], best[j] + cost + two)
        for size in (4, 6, 7, 8, 9, 10) if j < n and value[j] in "0123456789" else ():
            if j + size <= n and _DATE.fullmatch(value, j, j + size):
                cost = math.log10(120) if size == 4 else math.log10(365 * 120 * 4)
                best[j + size] = min(best[j + size], best[j] + cost + two)
    return best[n]


def scan_text(text: str, dictionary: tuple[dict[str, float], int] = _RANKED) -> list[tuple[int, int, int, int]]:
    """(start, number of the kind, end, start of the secret value) in order."""
    low = text.lower()
    found = []
    hints = [h for h in _HINTS if h in low]
    # The letters of the context patterns are ASCII, so a text without a hint has no match.
    if hints:
        found += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    if hints:
        base, reach, k = sorted(found), 0, 0
        for m in _CONTEXT.finditer(text):
            s, e = m.span(1)
            while k < len(base) and base[k][0] <= s:  # both in order: how far the spans that begin by here reach
                reach = max(reach, base[k][2])
                k += 1
            if e > reach and guess_cost(m[1], GUESSES, dictionary) >= GUESSES:
                found.append((s, 3, e, s))
    return sorted(found)


def _scan(dictionary):
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0), []
            for text in batch.column(1):
                t = text.as_py()
                out.append([{"kind": KINDS[k], "start": s, "end": e, "value_start": v} for s, k, e, v in scan_text(t, dictionary)] if t else [])
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(item))], names=["id", "spans"])

    return run


_SPANS = "spans array<struct<kind:string,start:long,end:long,value_start:long>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: tuple[str, ...] = WORDS) -> DataFrame:
    """id and spans (kind, start, end, value_start), by start and kind, for every row of ``docs``. ``words`` is the dictionary
    of guesses, most common first, such as a list of leaked passwords or a corpus's own most common words."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col)).transform(map_arrow, _scan(ranked(words)), f"id {kind}, {_SPANS}").withColumnRenamed("id", id_col)


def redact(text: str, mask: str, dictionary: tuple[dict[str, float], int] = _RANKED) -> str:
    parts, at = [], 0
    for begin, end in sorted((v, e) for _, _, e, v in scan_text(text, dictionary)):
        if end <= at:
            continue
        if begin > at or not parts:  # adjoining spans share a mask
            parts += [text[at:begin], mask]
        at = end
    return "".join(parts) + text[at:] if parts else text


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[REDACTED]", words: tuple[str, ...] = WORDS) -> DataFrame:
    """``docs`` with the secret values of the text masked: of an assignment its value, of other kinds the whole span.
    Null texts stay null, and texts without secrets are unchanged."""
    place, dictionary = docs.columns.index(text_col), ranked(words)

    def run(batches):
        for batch in batches:
            texts = pa.array([redact(t, mask, dictionary) if t else t for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), texts)

    return docs.transform(map_arrow, run, docs.schema)
