"""Personal data by offset-preserving deobfuscation (operator 11).

Four kinds of identifiers (e-mail addresses, IPv4 addresses, card numbers, phone numbers) are detected in a text as it is: the base
spans. Then transducers rewrite the text, each over what the one before it made:

1. characters: homoglyphs of other scripts, compatibility forms and decimal digits of any script become ASCII, dashes one dash, marks without width go;
2. digits: runs of spelled digits (English, German, French, Spanish, with "double", "plus" and spoken dots and dashes) and letters
   that stand for digits within numbers;
3. signs: at and dot in brackets, spoken, as character references or set apart by blanks.

Every transducer keeps a list of its edits, by which a place in what it made is traced to a place in what it read. The same detectors run on
the last text, and a span found there is mapped back through all of them to code points of the source. It is added if the rewriting had a part in it (its
text differs from the source's) and no base span of its kind covers it. Added e-mail addresses must end in letters. Matches that failed a check are
looked at once more, in the source too: a card number among others in a row and a phone number before other digits are added.

Detection is linear in the text: patterns start at the first character of a run and give nothing back. Rows are independent,
nothing is shuffled, a task holds one text and its edits at a time.

Edge cases: null and empty texts have no spans; very long texts are read whole; rows that repeat are each searched; an
empty table gives no rows; other columns don't matter to ``find_identifiers`` and are kept by ``redact``.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import give_back

# The kinds in their order, and what each looks like. A run is taken as a whole, which finds what the plain patterns find
# (email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), card [0-9]([\x20-]?[0-9])+) in linear time.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(?:@([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++))?")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PIECES = re.compile(r"[0-9]++")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether a card number's check digit fits."""
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return (sum(map(int, digits[-1::-2])) + sum(twice[int(d)] for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From the first run before each sign on; a text is cut at signs, so other runs aren't looked at."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m and m[1]:
            yield m.span()
        done = m.end() if m and m[1] else at + 1
        at = text.find("@", done)


def _is_ip(found: str) -> bool:
    parts = (part.lstrip("0") for part in found.split("."))
    return all(len(part) < 4 and int(part or "0") <= 255 for part in parts)


def _is_card(digits: str) -> bool:
    return 14 <= len(digits) <= 19 and luhn(digits)


def detect(text: str, again: list[Span] | None = None) -> list[Span]:
    """All identifiers of a text as (kind, start, end), leftmost and without overlaps within a kind.

    Matches that fail a check are dropped. With ``again`` they are looked at once more, and what they hold goes there: a card number among
    others that stand in a row, a phone number before other digits.
    """
    out = [("email", a, b) for a, b in _emails(text)]
    out += (("ip", *m.span()) for m in IP.finditer(text) if _is_ip(m[0]))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 14:
            continue
        if m.end() - m.start() <= 37 and _is_card(m[0].replace(" ", "").replace("-", "")):
            out.append(("card", *m.span()))
        elif again is not None:
            again += (("card", *piece.span()) for piece in PIECES.finditer(text, *m.span()) if _is_card(piece[0]))
    if "+" in text:
        for m in PHONE.finditer(text):
            n = sum(map(str.isdigit, m[0]))
            if 10 <= n <= 15:
                out.append(("phone", *m.span()))
            elif n > 15 and again is not None:
                n, end = 0, 0
                for piece in PIECES.finditer(text, *m.span()):
                    n += len(piece[0])
                    if n > 15:
                        break
                    end = piece.end() if n >= 10 else end
                if end:
                    again.append(("phone", m.start(), end))
    return out


Edit = tuple[int, int, str]


class Rewritten:
    """A text with edits applied, and where its characters are from. edits: (start, end, replacement), in order and apart."""

    def __init__(self, source: str, edits: list[Edit]) -> None:
        parts, at, size = [], 0, 0
        self.starts, self.ends, self.from_starts, self.from_ends = [], [], [], []
        for start, end, new in edits:
            parts += (source[at:start], new)
            size += start - at
            self.starts.append(size)
            size += len(new)
            self.ends.append(size)
            self.from_starts.append(start)
            self.from_ends.append(end)
            at = end
        self.text = "".join([*parts, source[at:]])

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source's span of a span that isn't empty: an edit that it touches counts as a whole, one at its border not."""
        return self._place(start)[0], self._place(end - 1)[1]

    def _place(self, k: int) -> tuple[int, int]:
        i = bisect_right(self.starts, k) - 1
        if i < 0:
            return k, k + 1
        if k < self.ends[i]:
            return self.from_starts[i], self.from_ends[i]
        return k - self.ends[i] + self.from_ends[i], k - self.ends[i] + self.from_ends[i] + 1


# Letters that look like Latin ones, dashes, dots, and marks without width.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХЗаеѕіјорсухкмнтвԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχγɑɡıօսոցհ",
        "ABESIJKMHOPCTYX3aesijopcyxkmhtvdqwhlABEZHIKMNOPTYXaeiknoptuxyagiounqh",
        strict=True,
    )
)
DASHES, DOTS, UNSEEN = "‐‑‒–—―−", "․。｡。", "­​‌‍⁠﻿᠎‎‏"
#: Compatibility forms that are only another look of a character; powers, indices and fractions aren't.
LOOKS = ("<font>", "<wide>", "<narrow>", "<circle>", "<square>", "<small>", "<compat>", "<noBreak>")


@lru_cache(maxsize=1)
def _characters() -> dict[str, str]:
    """Character -> what it stands for."""
    table = LOOKALIKES | dict.fromkeys(DASHES, "-") | dict.fromkeys(DOTS, ".") | dict.fromkeys(UNSEEN, "")
    for code in range(0x80, 0x20000):
        c = chr(code)
        if c not in table:
            if (digit := unicodedata.decimal(c, None)) is not None:
                table[c] = str(digit)
            elif unicodedata.decomposition(c).startswith(LOOKS) and (folded := unicodedata.normalize("NFKC", c)).isascii():
                table[c] = folded
    return table


def characters(text: str) -> tuple[str, list[Edit]]:
    """(text with characters exchanged one for one, edits for the others)."""
    if text.isascii() or not (met := _characters().keys() & set(text)):
        return text, []
    table = {c: _characters()[c] for c in met}
    uneven = [c for c in met if len(table[c]) != 1]
    edits = [(m.start(), m.end(), table[m[0]]) for m in re.finditer("[" + "".join(map(re.escape, uneven)) + "]", text)] if uneven else []
    return text.translate({ord(c): x for c, x in table.items() if len(x) == 1}), edits


# Spelled digits of four languages.
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "fuenf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
REPEATS = {"double": 2, "triple": 3}
SPOKEN = {"dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-", "minus": "-", "tiret": "-", "bindestrich": "-", "guion": "-", "guión": "-"}
PLUS = ("plus", "más", "mas")
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = rf"(?:(?:{'|'.join(REPEATS)})[ ]+)?(?:{_WORD})(?!\w)"
#: A digit word that a digit word or numeral stands next to, with the run around it.
_GAP = rf"(?:[ ]?[,/-][ ]?|[ ]{{1,3}}|[ ]+(?:{'|'.join(SPOKEN)})[ ]+)"
RUN = re.compile(rf"(?<!\w)(?:(?:{'|'.join(PLUS)})[ ]+)?(?:{_SPELLED}|[0-9]++(?=[ ,/-]{{1,3}}(?:[^\W\d_]+[ ]+)?(?:{_WORD})(?!\w))(?!\w))(?:{_GAP}(?:{_SPELLED}|[0-9]++(?!\w)))++", re.IGNORECASE)
SPELLED = re.compile(_SPELLED, re.IGNORECASE)
HAS_WORD = re.compile(rf"(?<!\w)(?:{_WORD})(?!\w)", re.IGNORECASE)
TOKEN = re.compile(rf"(?<!\w)(?:{_SPELLED}|[0-9]++)", re.IGNORECASE)
# Letters that stand for digits within numbers.
LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1", "S": "5", "B": "8"}
MIXED = re.compile(r"(?<!\w)[0-9OoIl|SB]++(?!\w)")


def _branches(words: list[str]) -> str:
    """A pattern of words, by their first letters."""
    by: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items())


_HEADS, _NUMBER, _ANY = "".join(sorted({w[0] for w in DIGIT_WORDS})), _branches([*DIGIT_WORDS]), _branches([*DIGIT_WORDS, *REPEATS, *SPOKEN])
#: What a run or a mixed number can't do without, looked for first since few texts have it (runs in lower-case text, one pattern after the other).
RUN_HINTS = [
    re.compile(rf"[ ,/-](?:{_ANY})(?!\w)"),
    re.compile(rf"[{_HEADS}](?<!\w\w)(?<=(?=(?:{_NUMBER})(?!\w)(?:[ ,/-]{{1,3}}(?:[0-9]|{_ANY})|[ ](?:{_branches([*SPOKEN])})[ ])).)|[0-9][ ,/-]{{1,3}}(?:{_ANY})(?!\w)"),
]
MIXED_HINT = re.compile(r"[0-9](?:[OoIl|SB]|\.[OoIl])|[OoIl|SB]\.?[0-9]")


def _spoken_number(text: str, start: int, end: int) -> Iterator[Edit]:
    """Edits of a run: digit words become digits, and the gaps around them go or become the sign that they name."""
    tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text, start, end)]
    if text[start] not in "0123456789" and tokens and tokens[0][0] > start:
        yield start, tokens[0][0], "+"
    for (a, b, token), after in zip(tokens, [*tokens[1:], None], strict=True):
        word = not token[0].isdigit()
        if word:
            *times, name = token.lower().split()
            yield a, b, str(DIGIT_WORDS[name]) * REPEATS.get(times[0] if times else "", 1)
        if after:
            gap = text[b : after[0]]
            sign = SPOKEN.get(gap.strip().lower())
            if sign or word or not after[2][0].isdigit():
                yield b, after[0], sign or ""


def digits(text: str) -> list[Edit]:
    """Edits of spelled digits in runs, and of letters in numbers."""
    low = text.lower()
    edits = [e for m in RUN.finditer(text) if HAS_WORD.search(m[0]) for e in _spoken_number(text, *m.span())] if all(h.search(low) for h in RUN_HINTS) else []
    taken = [(a, b) for a, b, _ in edits]
    for m in MIXED.finditer(text) if MIXED_HINT.search(text) else ():
        n = sum(c in "0123456789" for c in m[0])
        dotted = text[m.end() : m.end() + 1] == "." or text[m.start() - 1 : m.start()] == "."  # one part of several may be a letter alone
        if len(m[0]) > n and (2 * n >= len(m[0]) > 2 or dotted and len(m[0]) < 4):
            k = bisect_right(taken, (m.start(), len(text)))
            if not (k and taken[k - 1][1] > m.start()) and not (k < len(taken) and taken[k][0] < m.end()):
                edits += ((m.start() + j, m.start() + j + 1, LETTERS[c]) for j, c in enumerate(m[0]) if c in LETTERS)
    return sorted(edits)


# Spoken signs by language, at with its dot.
AT_DOT = {"at": "dot", "arroba": "punto", "arobase": "point", "arobas": "point", "klammeraffe": "punkt", "ät": "punkt"}
_OPEN, _CLOSE, _B = r"[\[({<]", r"[\])}>]", r"[ \t]{0,3}+"
_ATS, _DOTS = "|".join(AT_DOT), "|".join(dict.fromkeys(AT_DOT.values()))
_DOT_IN = rf"{_B}{_OPEN}{_B}(?:{_DOTS}|\.){_B}{_CLOSE}{_B}"
_LABEL = r"[A-Za-z0-9-]++"
_REF_AT, _REF_DOT = r"&(?:\#0*64|\#x0*40|commat);", r"&(?:\#0*46|\#x0*2e|period);"
_BARE_AT = "|".join(rf"[ ]{{1,3}}+{at}[ ]{{1,3}}+(?={_LABEL}(?:[ ]{{1,3}}+(?:dot|{dot})[ ]|{_DOT_IN}))" for at, dot in AT_DOT.items())
AT = re.compile(
    rf"(?<=[A-Za-z0-9_%+-])(?:{_B}{_OPEN}{_B}(?:{_ATS}|@){_B}{_CLOSE}{_B}|{_B}{_REF_AT}{_B}|{_BARE_AT}|[ ]{{1,3}}+@{_B}(?={_LABEL}(?:\.|[ ]\.[ ]|[ ]dot[ ]|{_DOT_IN})[A-Za-z0-9])|@[ ]{{1,3}}+(?={_LABEL}(?:\.|[ ]\.[ ]|[ ]dot[ ])[A-Za-z0-9]))(?=[A-Za-z0-9])",
    re.IGNORECASE,
)
DOT = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:{_DOT_IN}|{_B}{_REF_DOT}{_B}|[ ]{{1,3}}+(?:{_DOTS})[ ]{{1,3}}+)(?=[A-Za-z0-9])", re.IGNORECASE)
APART = re.compile(rf"@{_LABEL}((?:[ ]\.[ ]{_LABEL})+)")
#: What a disguised sign can't do without, in lower-case text: each begins with plain characters, which are found fast.
AT_HINTS = [re.compile(x) for x in (rf"{_OPEN}{_B}(?:{_ATS}|@)", _REF_AT, "[ ]@|@[ ]", *(rf" {at}[ ]{{1,3}}{_LABEL}(?:[ ]{{1,3}}(?:dot|{dot}) |{_DOT_IN})" for at, dot in AT_DOT.items()))]
DOT_HINTS = [re.compile(x) for x in (rf"{_OPEN}{_B}(?:{_DOTS}|\.)", _REF_DOT, *(rf" {dot}[ ]{{1,3}}[0-9]" for dot in dict.fromkeys(AT_DOT.values())))]


def signs(text: str) -> list[Edit]:
    """Edits of disguised at signs and dots. Spoken dots count where there is an at sign or a digit after them."""
    low = text.lower()
    edits = [(*m.span(), "@") for m in AT.finditer(text)] if any(h.search(low) for h in AT_HINTS) else []
    if edits or "@" in text or any(h.search(low) for h in DOT_HINTS):
        edits += ((*m.span(), ".") for m in DOT.finditer(text))
    return sorted(edits)


def _apart(text: str) -> list[Edit]:
    """Edits of dots that blanks set apart, in domains where all are."""
    return [(m.start(1) + d.start(), m.start(1) + d.end(), ".") for m in APART.finditer(text) for d in re.finditer(r"[ ]\.[ ]", m[1])] if "@" in text and " . " in text else []


def rewrite(text: str) -> tuple[str, list[Rewritten]]:
    """What all transducers make of a text, and their edits, first to last."""
    text, edits = characters(text)
    steps = []
    for step in (None, digits, signs, _apart):
        edits = step(text) if step else edits
        if any(b[0] < a[1] for a, b in pairwise(edits)):  # of edits that overlap the first stays
            kept: list[Edit] = []
            for e in edits:
                if not kept or e[0] >= kept[-1][1]:
                    kept.append(e)
            edits = kept
        if edits:
            steps.append(Rewritten(text, edits))
            text = steps[-1].text
    return text, steps


class _Cover:
    """Spans that don't overlap."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def holds(self, start: int, end: int) -> bool:
        """Whether one of them covers a span."""
        i = bisect_right(self.starts, start) - 1
        return i >= 0 and end <= self.ends[i]


def identifiers(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of a text, by start, then kind, then end."""
    text = text or ""
    again: list[Span] = []
    base = detect(text, again)
    normal, steps = rewrite(text)
    held, found = set(base), again
    if normal != text:
        more: list[Span] = []
        for kind, a, b in detect(normal, more) + more:
            start, end = a, b
            for step in reversed(steps):
                start, end = step.source(start, end)
            if text[start:end] != normal[a:b] and (kind != "email" or normal[a:b].rpartition(".")[2].isalpha()):
                found.append((kind, start, end))
    covered = {k: _Cover([(s, e) for kind, s, e in base if kind == k]) for k in KINDS}
    out = [(*s, True) for s in base]
    for span in found:
        if span not in held and not covered[span[0]].holds(*span[1:]):
            held.add(span)
            out.append((*span, False))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind string, start long, end long, base boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_identifiers(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row; spans: kind, start and end (code points, end exclusive), whether it is a base span."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in identifiers(value.as_py())] for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _ARROW)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: give_back(find(it)), f"doc_id long, spans {SPANS}")


def mask(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """``text`` with each stretch that spans cover as the kind of the first of them, in angle brackets."""
    parts, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            parts += (text[at:start], f"<{kind.upper()}>")
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with masked texts; null stays null, all columns are kept."""
    at = docs.columns.index("text")

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else mask(t, identifiers(t)) for t in (value.as_py() for value in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 :]], schema=batch.schema)

    return docs.mapInArrow(lambda it: give_back(hide(it)), docs.schema)


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of base spans, all spans as text: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)."""
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    rows = found.withColumn("base", base)
    counts: list[Column] = [count(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
