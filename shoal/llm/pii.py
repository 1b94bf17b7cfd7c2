"""Personal data, disguised or not: transducers that keep offsets, then detection.

Plain identifiers are found in the text as it is.  For the rest, two transducers
rewrite the text: the first maps look-alike characters one to one, the second
rewrites disguises (``[at]``, ``dot``, spelled digits, ``plus``) and records which
source characters each output character came from.  Identifiers found in the
rewritten text are mapped back to source spans.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import documents, map_arrow

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive runs and the look-behind find the same matches as plain greedy ones, without going back
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(t: str) -> Iterator[Span]:
    """From each @: the run of local characters before it and the domain after it."""
    free, i = 0, t.find("@")
    while i >= 0:
        j = i
        while j > free and t[j - 1] in _LOCAL:
            j -= 1
        m = _DOMAIN.match(t, i + 1) if j < i else None
        if m:
            yield j, m.end()
            free = m.end()
        i = t.find("@", m.end() if m else i + 1)


def ips(t: str) -> Iterator[Span]:
    for m in _IP.finditer(t):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            yield m.span()


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(t: str) -> Iterator[Span]:
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(t: str) -> Iterator[Span]:
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Letters of other scripts that look like Latin ones.
_LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    "․": ".", "。": ".", "·": ".", "•": ".", "\u00a0": " ", "\u2007": " ", "\u202f": " ",
}
_DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
                "seven": "7", "eight": "8", "nine": "9"}
_LETTER_DIGITS = str.maketrans("OoIl|", "00111")
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


@lru_cache(1)
def look_alikes() -> dict[int, str]:
    """Character table of the first transducer: compatibility forms of single ASCII characters
    (full-width, styled, circled) by rule, decimal digits of all scripts, and the listed letters."""
    table = {ord(k): v for k, v in _LOOK_ALIKES.items()}
    for c in range(0x80, 0x20000):
        ch = chr(c)
        plain = unicodedata.normalize("NFKC", ch)
        if len(plain) == 1 and plain.isascii() and plain.isprintable():
            table.setdefault(c, plain)
        elif unicodedata.decimal(ch, None) is not None:
            table.setdefault(c, str(unicodedata.decimal(ch)))
    return table


_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_DIGIT = "|".join(_DIGIT_WORDS)
# A dot with a space after it only ends a sentence; see ``gap`` below for the one exception.
_DOT = rf"(?:{_OPEN}(?:dot|\.){_CLOSE}|\s+dot\s+|\s+\.\s*)"
# Endings after which "name at host dot ending" in plain words is taken for an address.
_REAL = "com|org|net|edu|gov|info|biz|io|co|dev|app|eu|de|fr|es|it|nl|ch|at|uk|us|ca"
_ENDING = _REAL + "|example|test"
_HOST = rf"(?:[A-Za-z0-9-]+(?:{_DOT}|\.))+(?:{_ENDING})\b"
_ENTITY = r"&#0*64;|&commat;"
#: The disguises; plain words and spaced signs count as @ and . only in a host with a known ending, and
#: letters count as digits only beside digits.  ``host. com`` has a dot only right after an at sign, if the
#: host has no ending yet and the one to come is not capitalised like the first word of a sentence.
_DISGUISE = re.compile(
    rf"(?P<gap>(?:{_OPEN}(?:at|@){_CLOSE}|{_ENTITY}|\s*@\s*)"
    rf"(?P<host>[A-Za-z0-9-]+(?:(?:{_DOT}|\.)(?!(?:{_REAL})\.\s)[A-Za-z0-9-]+)*)\.\s+"
    rf"(?P<ending>(?-i:{_ENDING}|{_ENDING.upper()}))\b)"
    rf"|(?P<at>{_OPEN}(?:at|@){_CLOSE}|{_ENTITY}|(?<=[A-Za-z0-9])(?:\s+at\s+|\s+@\s*|@\s+)(?={_HOST}))"
    rf"|(?P<dot>{_OPEN}(?:dot|\.){_CLOSE}|&#0*46;|(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])"
    rf"|(?<=[A-Za-z0-9])\s+\.\s*(?=(?:{_ENDING})\b))"
    rf"|\b(?P<digits>(?:{_DIGIT})(?:[\s-]+(?:{_DIGIT}))*)\b"
    r"|(?P<letters>(?<=[0-9])[OoIl|]+(?=[0-9 .)-]|$)|(?<![A-Za-z0-9])[OoIl|]+(?=[0-9]|\.[0-9])"
    r"|(?<=[0-9OIl]\.)[OoIl|]{1,3}(?=\.|[^A-Za-z0-9]|$))"
    rf"|(?P<plus>\bplus\s+(?=[0-9]|(?:{_DIGIT})\b))"
    rf"|(?P<gone>[{_INVISIBLE}]+)", re.IGNORECASE)
_DOTS = re.compile(rf"{_DOT}|\.", re.IGNORECASE)
#: A cheap look for anything that the second transducer rewrites: a text without a match, and without an @,
#: has none of ``_DISGUISE``.  Each branch there has a part here that it can't do without.
_TRIGGER = re.compile(rf"[\[({{<]\s*(?:at|dot|\.)\s*[\])}}>]|&(?:#|commat;)|\s(?:dot\s|\.|at\s+{_HOST})|\bplus\s|[0-9][oil|]"
                      rf"|[oil|]\.?[0-9]|[0-9oil]\.[oil|]{{1,3}}(?![A-Za-z0-9])|\b(?:{_DIGIT})\b|[{_INVISIBLE}]", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+", re.IGNORECASE)


def may_rewrite(t: str) -> bool:
    """False only for texts that the second transducer leaves as they are."""
    return "@" in t or _TRIGGER.search(t) is not None


class Rewritten:
    """A rewritten text and, for each change, where it starts and ends here and in the source."""

    def __init__(self, source: str) -> None:
        parts, self._at, self._end, self._from, self._to = [], [], [], [], []
        last = size = 0
        for m in _DISGUISE.finditer(source):
            kind = m.lastgroup
            new = {"at": "@", "dot": ".", "plus": "+", "gone": ""}.get(kind)
            if kind == "gap":
                new = f"@{_DOTS.sub('.', m['host'])}.{m['ending']}"
            elif kind == "letters":
                new = m[0].translate(_LETTER_DIGITS)
            elif new is None:
                new = "".join(_DIGIT_WORDS[w.lower()] for w in _WORD.findall(m[0]))
            parts += [source[last:m.start()], new]
            size += m.start() - last
            self._at.append(size)
            size += len(new)
            self._end.append(size)
            self._from.append(m.start())
            self._to.append(m.end())
            last = m.end()
        self.text = "".join([*parts, source[last:]])

    def source_start(self, i: int) -> int:
        """Where the output character at ``i`` begins in the source."""
        k = bisect_right(self._at, i) - 1
        while k >= 0 and self._at[k] == self._end[k] == i:   # an invisible run right before: after it
            return self._to[k]
        if k < 0:
            return i
        return self._from[k] if i < self._end[k] else self._to[k] + i - self._end[k]

    def source_end(self, i: int) -> int:
        """Where the output character before ``i`` ends in the source."""
        k = bisect_right(self._at, i - 1) - 1
        if k < 0:
            return i
        return self._to[k] if i <= self._end[k] else self._to[k] + i - self._end[k]


def base_spans(t: str) -> dict[str, list[Span]]:
    return {k: list(f(t)) for k, f in FINDERS.items()}


def added_spans(t: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Source spans of the identifiers that only the rewritten text shows."""
    plain = t if t.isascii() else t.translate(look_alikes())
    if plain == t and not may_rewrite(plain):
        return {}
    seen = Rewritten(plain)
    if seen.text == t:
        return {}
    out = {}
    for kind, find in FINDERS.items():
        spans = {(seen.source_start(a), seen.source_end(b)) for a, b in find(seen.text)}
        new = [s for s in spans if not any(a <= s[0] and s[1] <= b for a, b in base[kind])]
        if new:
            out[kind] = sorted(new)
    return out


def spans_of(t: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """The plain and the added spans by kind, in code points, ends exclusive."""
    base = base_spans(t or "")
    return base, added_spans(t or "", base)


def _listed(found: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(found.get(k, [])))


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id``, the plain and all spans as ``kind:start:end`` lists, plain counts by kind.

    Null texts count as empty and have no spans.  Repeated rows and null ids are rows
    like others; an empty table gives an empty result.  Only the two columns are read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, base, every = [], [], []
            for t in b.column(1).to_pylist():
                plain, more = spans_of(t)
                counts.append([len(plain[k]) for k in KINDS])
                base.append(_listed(plain))
                every.append(_listed({k: plain[k] + more.get(k, []) for k in KINDS}) if more else base[-1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
                 pa.array(every, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(src, run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
                     + ", base_sha256 string, spans string")


def redacted(t: str | None) -> str | None:
    """The text with every span, plain or added, replaced by its kind in brackets; overlaps go together."""
    if not t:
        return t
    base, more = spans_of(t)
    spans = sorted((a, b, k) for k in KINDS for a, b in base[k] + more.get(k, []))
    out, last = [], 0
    for a, b, k in spans:
        if a >= last:
            out += [t[last:a], f"[{k.upper()}]"]
        last = max(last, b)
    return "".join([*out, t[last:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all columns, with personal data in ``text`` replaced."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([redacted(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    plain = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return map_arrow(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), run, plain).toDF(*docs.columns)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir))
