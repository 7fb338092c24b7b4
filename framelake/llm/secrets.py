"""Secret scans: fixed patterns, and guess costs of values that stand where credentials do.

Base kinds, leftmost and non-overlapping for each: `assign`, `access` and `hex` (see PATTERNS; matches that fail their
length rule are dropped). The method adds kind `guess`: a value that follows a credential word, a separator and perhaps a
quote, up to the next white space or quote, whose cheapest segmentation (dictionary words, dates, repeats, keyboard
walks, brute force) of the whole value takes at least LEAST_GUESSES guesses. Spans are in code points, end exclusive,
sorted by start, then by kind in the order above. Null and empty texts have no spans; each row is scanned whole.

The dictionary has COMMON_WORDS and the words of all the documents, ranked by how often they occur outside values in
credential context (or a credential would make itself known). Only words that those values can hold are handed to tasks.
"""

import functools
import heapq
import math
import operator
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import staged

KINDS = ("assign", "access", "hex", "guess")
_WORDS = r"password|passwd|secret|token|api_?key"
#: kind -> (pattern, the group whose length counts, least length); letters of `assign`'s words in either case.
PATTERNS = {
    "assign": (re.compile(rf"((?i:{_WORDS}))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # runs are maximal: the same as [0-9a-f]+ of 24 or more
}
# White space of Unicode, written so that Python and Java read it alike.
_SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where credentials stand: a word for them, a separator, and a value of 8 signs or more without white space or quotes.
CONTEXT = re.compile(r"(?i:password|passwd|passphrase|pwd|secret|token|api_?key|credential|private_?key|access_?key|auth)[\"']?\x20*(?:=>|:=|[:=])\x20*[\"']?([^" + _SPACE + r"\"']{8,})", re.ASCII)
_HINTS = ("passw", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "credential", "vatekey", "vate_key", "accesskey", "access_key", "auth")
#: Guesses beyond which a value counts as made, not as chosen for its looks.
LEAST_GUESSES = 1e10
LEAST_BITS = math.log2(LEAST_GUESSES)

# Common parts of passwords, most frequent first (the rank is the number of guesses).
COMMON_WORDS = """
password 123456 qwerty admin welcome letmein monkey dragon master login princess sunshine shadow football baseball
secret token example sample test demo changeme default user root guest hello love money summer winter spring autumn
the and for you are not with this that from have your what when will can all one out about time there which their would
public private key access value string number name data house water world family company system group money school
""".split()
#: Bits of a known word by its rank.
COMMON = {w: math.log2(i + 2) for i, w in reversed(list(enumerate(COMMON_WORDS)))}
#: The words of the documents that a task holds at most: of those that values in credential context can hold and that are
#: cheaper than their letters, the most frequent (512 Ki words, about 90 MB of a worker's memory).
MOST_WORDS = 1 << 19
#: Words are compared with values by hashes of their first and next runs of so many letters.
GRAM, GRAM_BITS = 5, 20
# Rows of the keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACES = {key: (row, at) for row, keys in enumerate(KEY_ROWS) for at, key in enumerate(keys)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
_LEET = str.maketrans("430157$@!", "aeoistsai")


def _near(a: str, b: str) -> bool:
    p, q = _PLACES.get(a), _PLACES.get(b)
    return bool(p and q) and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _brute(sign: str) -> float:
    """Bits of one sign that nothing explains; beyond ASCII, the code points up to it."""
    return math.log2(10 if "0" <= sign <= "9" else 33 if sign < "\x80" and not sign.isalpha() else 26 if sign < "\x80" else ord(sign))


class Words:
    """COMMON and other words, each with its bits; the fewer count."""

    def __init__(self, more: Mapping[str, float] = {}):
        self.bits = {**more, **{w: min(b, more.get(w, b)) for w, b in COMMON.items()}}
        self.sizes = sorted(set(map(len, self.bits)))


class Pieces:
    """The spans of a value that a guesser knows and that cost less than limit bits; asked for by rising start.

    A block, a run of equal signs apart, costs log2(10) bits a sign at least, so the limit bounds its size, and a walk's
    length too: all pieces below the limit are found in time linear in the value's length."""

    def __init__(self, value: str, limit: float, words: "Words"):
        self.value, self.limit, self.words = value, limit, words
        self.lower = "".join(low if len(low := sign.lower()) == 1 else sign for sign in value)
        self.plain = self.lower.translate(_LEET)
        self.block = min(len(value) // 2, int(min(limit / math.log2(10), len(value))))
        self.equal: dict[int, int] = {}

    def differs(self, i: int, size: int) -> int:
        """The first place from i on whose sign isn't the one that follows size places later."""
        value, k = self.value, max(i, self.equal.get(size, 0))
        while k + size < len(value) and value[k] == value[k + size]:
            k += 1
        self.equal[size] = k
        return k

    def starting(self, i: int) -> Iterator[tuple[int, float]]:
        """(end, bits) of the pieces that start at i."""
        value, lower, n = self.value, self.lower, len(self.value)
        for j in (i + size for size in self.words.sizes):
            if j > n:
                break
            for form, extra in ((lower, 0.0), (self.plain, 1.0)):
                if bits := self.words.bits.get(form[i:j]):
                    yield j, bits + extra + (0.0 if value[i:j] == lower[i:j] else 1.0)
                    break
        if match := _DATE.match(value, i):
            yield match.end(), math.log2(366 * 130 if match.end() - i > 4 else 130)
        j = self.differs(i, 1) + 1
        if j - i >= 3:
            yield j, _brute(value[i]) + math.log2(j - i)
        for size in range(2, min(self.block, (n - i) // 2) + 1):  # a repeated block
            times = 1 + (self.differs(i, size) - i) // size
            if times > 1:
                yield i + times * size, sum(map(_brute, value[i : i + size])) + math.log2(times)
        j, bits = i + 1, math.log2(47)
        while j < n and bits < self.limit and _near(lower[j - 1], lower[j]):
            j, bits = j + 1, bits + 1.5
        if j - i >= 3:  # a walk: its first key, then a turn or none at each step
            yield j, bits
        j = i + 1
        while j < n and abs(ord(value[j]) - ord(value[j - 1])) == 1 and value[j].isascii() and value[j].isalnum() and ord(value[j]) - ord(value[j - 1]) == ord(value[i + 1]) - ord(value[i]):
            j += 1
        if j - i >= 3:  # abc, 321
            yield j, _brute(value[i]) + math.log2(j - i) + 1


def guess_bits(value: str, limit: float = math.inf, words: Words = Words()) -> float:
    """log2 of the guesses that the cheapest segmentation of the whole value takes, or limit if it takes so many or more.

    best[j] = min over pieces ending at j; places that only cost limit or more lead to are never visited."""
    known, best, places = Pieces(value, limit, words), {0: 0.0}, [0]
    while places:
        i = heapq.heappop(places)
        if i == len(value):
            return best[i]
        for j, bits in ((i + 1, _brute(value[i])), *((j, bits + 0.5) for j, bits in known.starting(i))):
            if best[i] + bits < min(limit, best.get(j, math.inf)):
                if j not in best:
                    heapq.heappush(places, j)
                best[j] = best[i] + bits
    return limit


def _grams(word: str) -> set[int]:
    """Hashes of the word's runs of GRAM signs, or of the word if it is shorter."""
    return {zlib.crc32(word[k : k + GRAM].encode("utf-8", "replace")) >> (32 - GRAM_BITS) for k in range(max(1, len(word) - GRAM + 1))}


def _grams_of(value: str) -> set[int]:
    """Hashes of what a word in value can have for _grams."""
    known = Pieces(value, LEAST_BITS, Words())
    found = set()
    for form in (known.lower, known.plain):
        for size in range(3, GRAM + 1):
            for k in range(len(form) - size + 1):
                found.add(zlib.crc32(form[k : k + size].encode("utf-8", "replace")) >> (32 - GRAM_BITS))
    return found


def known_words(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Words of the documents (runs of 3 letters or more, lower case) with their bits; of equally frequent words each has
    the last one's rank. The driver gets at most 2^GRAM_BITS hashes, a row per distinct count, and MOST_WORDS words."""

    def held(batches):
        for batch in batches:
            found: set[int] = set()
            for t in batch.column(0).to_pylist():
                for value in _values(t or ""):
                    if guess_bits(value, LEAST_BITS) >= LEAST_BITS:
                        found |= _grams_of(value)
            yield pa.record_batch([pa.array(sorted(found), pa.int32())], ["gram"])

    grams = docs.select(text).mapInArrow(held, "gram int").distinct().toPandas()["gram"].to_numpy()
    if not len(grams):  # no value that a word could explain
        return {}
    lower = F.lower(text)
    hinted = functools.reduce(operator.or_, (lower.contains(h) for h in _HINTS))
    outside = F.when(hinted, F.lower(F.regexp_replace(text, CONTEXT.pattern, " "))).otherwise(lower)
    words = docs.select(F.explode(F.split(outside, r"[^\p{L}\p{M}]+")).alias("word")).where("length(word) >= 3")
    counted = staged(words.groupBy("word").agg(F.count("*").alias("n")))
    sizes = sorted(((r["n"], r["count"]) for r in counted.groupBy("n").count().collect()), reverse=True)
    ranks = dict(zip([n for n, _ in sizes], np.cumsum([c for _, c in sizes]).tolist()))
    shared = np.zeros(1 << GRAM_BITS, bool)
    shared[grams] = True
    known = docs.sparkSession.sparkContext.broadcast((shared, ranks))

    def useful(batches):
        table, rank = known.value
        for batch in batches:
            found = ((w, n, math.log2(rank[n] + 1)) for w, n in zip(*(c.to_pylist() for c in batch.columns)))
            rows = [(w, n, bits) for w, n, bits in found if bits + 0.5 < sum(map(_brute, w)) and all(table[g] for g in _grams(w))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.int64(), pa.float64()))], ["word", "n", "bits"])

    chosen = counted.mapInArrow(useful, "word string, n long, bits double")
    least, total = 0, 0
    for n, c in sorted(((r["n"], r["count"]) for r in chosen.groupBy("n").count().collect()), reverse=True):
        total += c
        if total > MOST_WORDS:
            least = n + 1
            break
    table = chosen.where(F.col("n") >= least).select("word", "bits").toPandas()
    return dict(zip(table["word"], table["bits"].tolist()))


def _values(text: str) -> Iterator[str]:
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        yield from (m[1] for m in CONTEXT.finditer(text))


def spans_of(text: str, words: Words = Words()) -> list[tuple[str, int, int]]:
    lower = text.lower()
    found = []
    hinted = [h for h in _HINTS if h in lower]
    for kind, (pattern, group, least) in PATTERNS.items():
        if kind == "assign" and not hinted or kind == "access" and "AKIA" not in text:
            continue
        found += [(kind, *m.span()) for m in pattern.finditer(text) if len(m[group]) >= least]
    if hinted:
        found += [("guess", *m.span(1)) for m in CONTEXT.finditer(text) if guess_bits(m[1], LEAST_BITS, words) >= LEAST_BITS]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind, start, end>>), one row for each row of docs; only words and their counts are shuffled."""
    words = docs.sparkSession.sparkContext.broadcast(Words(known_words(docs, text)))

    def rows(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t, words.value)] if t else [] for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array(spans, kind)], [key, "spans"])

    return docs.select(key, text).mapInArrow(rows, f"{key} {dict(docs.dtypes)[key]}, spans array<struct<kind: string, start: long, end: long>>")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != "guess")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
