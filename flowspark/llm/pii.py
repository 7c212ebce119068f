"""Personal data in texts, also disguised, at the places of the source's characters.

Four kinds are looked for: email addresses, IP numbers, card numbers (12 to 19 digits that pass Luhn's sum) and phone numbers
(a plus, 9 to 15 digits).  First in the text as it is (the base spans, leftmost and not overlapping within a kind; what fails a
kind's test is dropped and not tried again).  Then in a normalised text, made by three transducers, one after the other:

* characters: homoglyphs (Cyrillic and Greek letters, full-width and mathematical forms, digits of other scripts), the letters O, o, l and
  I between digits, dashes, spaces and dots of other kinds; invisible characters vanish;
* spelled digits: runs of three or more digit words of one to four languages in any mix ("nine seven double five", "plus un sept"), and
  single ones beside a spelled dot;
* at and dot: in brackets or as references (``[at]``, ``(dot)``, ``&#64;``) always; as plain words only where a domain with a known ending
  follows, or four numbers with spelled dots between them.

A transducer returns a text and its edits, (start, end) in its output and in its input; a span of the last text is taken back
through the edits of each, so an added span lies on the source's characters whatever was shortened, lengthened or dropped.  Added
spans are those that cover an edit and lie in no base span.  All patterns are linear in the text.

Defined cases: a null or empty text has no spans; repeated rows repeat; texts of any length are whole; a table without rows gives none;
the documents' columns of any names go along by number, only those named like a result are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, numbered, restored

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
#: Runs of digits with single separators; with the digits counted, the same spans as a digit and then separator-or-none and digit, repeated.
CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, str]
#: (start, end) in the output, (start, end) in the input.
Edit = tuple[int, int, int, int]


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From one @ to the next: the longest local part that no earlier match holds, and a domain."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        here = text[done:at]
        start = done + len(here.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            done = at = m.end()
        else:
            done = at = at + 1


def identifiers(text: str) -> list[Span]:
    """All spans (start, end, kind), by start and then by the order of the kinds."""
    out = list(emails(text))
    out += ((*m.span(), "ip") for m in IP.finditer(text) if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m.group().split("."))))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    out += ((*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# Letters of other scripts that look like Latin ones, and the Latin ones.
ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινρ",
        "ABESIJKMHOPCTYXaesijopcyxhdqwvABEZHIKMNOPTYXoivp",
        strict=True,
    )
) | {"ɡ": "g", "ı": "i", "ⅼ": "l", "ո": "n", "ս": "u", "օ": "o"}
INVISIBLE = "­᠎​‌‍⁠﻿"
DASHES, DOTS, SIGNS = "‐‑‒–—−﹣", "․。・｡﹒", "﹫"


class _Characters(dict):
    """What `str.translate` puts for a character, worked out once a character."""

    def __missing__(self, code: int):
        c = chr(code)
        if c in ALIKE:
            self[code] = ALIKE[c]
        elif c in DASHES:
            self[code] = "-"
        elif c in DOTS:
            self[code] = "."
        elif c in SIGNS:
            self[code] = "@"
        elif unicodedata.category(c) == "Zs":
            self[code] = " "
        elif unicodedata.category(c) == "Nd":
            self[code] = str(unicodedata.digit(c))
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>", "<font>")) and (n := unicodedata.normalize("NFKC", c)).isascii() and len(n) == 1:
            self[code] = n
        else:
            self[code] = c
        return self[code]


CHARACTERS = _Characters()
#: What stands for 0 and 1 in numbers: beside a digit, with no other letter on its far side.
DIGIT_LIKE = {"O": "0", "o": "0", "l": "1", "I": "1"}
NUMBER = re.compile(r"[0-9]+")

# Digit words of English, German, French and Spanish.
DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
TIMES = {"double": 2, "triple": 3}
SAYS_DIGIT = frozenset(DIGITS) | frozenset(TIMES)
_ONE = rf"(?:(?:{'|'.join(TIMES)})[ -])?(?:{'|'.join(sorted(DIGITS, key=len, reverse=True))})"
DOT_WORDS = ("dot", "punkt", "point", "punto")
_DOT = f"(?:{'|'.join(DOT_WORDS)})"
_PAIR = rf"{_ONE}(?:[ -]{_ONE})?"
SPELLED = re.compile(rf"(?<!\w)(?:plus[ -])?{_ONE}(?:[ ,-]{{1,2}}{_ONE}){{2,}}(?!\w)|(?<!\w){_PAIR}(?= {_DOT} )|(?:{'|'.join(f'(?<= {w} )' for w in DOT_WORDS)}){_PAIR}(?!\w)")
PLUS = re.compile(r"plus[ -](?=[0-9])")
WORDS = re.compile(r"\w+")

BRACKETED = re.compile(r"[\[({<]{1,2}[ \t]{0,2}(?:(?P<at>@|at|ät|arroba|arobase|klammeraffe)|(?P<dot>\.|dot|punkt|point|punto))[ \t]{0,2}[\])}>]{1,2}[ \t]{0,2}")
REFERENCE = re.compile(r"&(?:(?P<at>#64;|#x40;|commat;)|#46;|#x2e;|period;)")
# Endings of domains that plain words may spell.
ENDINGS = "com|net|org|edu|gov|mil|int|info|biz|io|co|dev|app|ai|uk|de|fr|es|eu|it|nl|ch|pt|br|mx|ca|au|jp|cn|ru|example|test|local"
#: Words that no spelled domain begins with.
ARTICLES = "the|a|an|this|that|each|every|one|my|your|our|his|her|der|die|das|le|la|el|les|los|las"
_GAP = r"[ \t]{1,3}"
_WORD_DOT = f"{_GAP}{_DOT}{_GAP}"
_SEP = rf"(?:{_WORD_DOT}|\.)"
#: A host name of which one dot at least is a word: up to 20 labels of up to 63 letters, as names have.
_LABEL = "[a-z0-9-]{1,63}"
_SAID = rf"((?:{_LABEL}\.){{0,9}}{_LABEL}{_WORD_DOT}(?:{_LABEL}{_SEP}){{0,9}}(?:{ENDINGS}))(?![\w-])"
_AT = rf"{_GAP}(?:at|arroba|arobase|klammeraffe){_GAP}"
PLAIN_AT = re.compile(rf"{_AT}(?=(?!(?:{ARTICLES})[ \t]){_SAID})")
#: a handle (with a mark or digit in it), at, and a domain with dots
HANDLE_AT = re.compile(rf"{_AT}(?=((?:{_LABEL}\.){{1,19}}(?:{ENDINGS}))(?![\w-]))")
SIGN_DOT = re.compile(rf"@(?={_SAID})")
DOT_WORD = re.compile(_WORD_DOT)
LOCAL_DOT = re.compile(rf"(?:[a-z0-9_%+-]+{_WORD_DOT})+$")
FOUR = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:[ \t]{{0,2}}{_DOT}[ \t]{{0,2}}|\.)[0-9]{{1,3}}){{3}}(?![0-9])")
ANY_DOT = re.compile(rf"[ \t]{{0,2}}{_DOT}[ \t]{{0,2}}")
#: Characters before a plain "at" in which its local part is looked for.
LOCAL_REACH = 200


def rewritten(text: str, changes: list[tuple[int, int, str]]) -> tuple[str, list[Edit]]:
    """``text`` with (start, end, new) put in, and the edits."""
    out, edits, at, size = [], [], 0, 0
    for start, end, new in sorted(changes):
        if start < at:
            continue
        out += (text[at:start], new)
        size += start - at
        edits.append((size, size + len(new), start, end))
        size += len(new)
        at = end
    out.append(text[at:])
    return "".join(out), edits


def source(edits: list[Edit], start: int, end: int) -> tuple[int, int]:
    """A span of the output as one of the input; an edit that it touches is taken whole."""

    def back(p: int, is_end: bool) -> int:
        k = bisect_right(edits, p - is_end, key=lambda e: e[0]) - 1
        if k < 0:
            return p
        out_start, out_end, in_start, in_end = edits[k]
        if p - is_end < out_end:
            return in_end if is_end else in_start
        return in_end + p - out_end

    return back(start, False), back(end, True)


def touched(edits: list[Edit], start: int, end: int) -> bool:
    k = bisect_right(edits, end - 1, key=lambda e: e[0]) - 1
    # an edit that left nothing behind counts only inside the span
    return k >= 0 and (edits[k][1] > start or start < edits[k][0] < end)


def characters(text: str) -> list[tuple[int, int, str]]:
    out = []
    if not text.isascii() and (odd := {c for c in set(text) if CHARACTERS[ord(c)] != c or c in INVISIBLE}):
        for m in re.finditer(f"[{re.escape(''.join(sorted(odd)))}]", text):
            out.append((*m.span(), "" if m.group() in INVISIBLE else CHARACTERS[ord(m.group())]))
        text = text.translate({ord(c): CHARACTERS[ord(c)] for c in odd if c not in INVISIBLE})
    for m in NUMBER.finditer(text):
        start, end = m.span()
        while start and text[start - 1] in DIGIT_LIKE:
            start -= 1
        if start < m.start() and not (start and text[start - 1].isalpha()):
            out += ((i, i + 1, DIGIT_LIKE[text[i]]) for i in range(start, m.start()))
        while end < len(text) and text[end] in DIGIT_LIKE:
            end += 1
        if end > m.end() and not (end < len(text) and text[end].isalpha()):
            out += ((i, i + 1, DIGIT_LIKE[text[i]]) for i in range(m.end(), end))
    return out


def lowered(text: str) -> str:
    """In lower case and as long as before (one letter alone would become two)."""
    return text.replace("\u0130", "I").lower()


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    low = lowered(text)
    out = [(*m.span(), "+") for m in PLUS.finditer(low) if not (m.start() and low[m.start() - 1].isalnum())]
    plain = low
    for mark in "-,.()":
        plain = plain.replace(mark, " ")
    words = plain.split()
    # a run has two digit words in a row, a single one counts beside a dot only
    if b"\1\1" not in bytes(map(SAYS_DIGIT.__contains__, words)) and not any(f" {w} " in low for w in DOT_WORDS):
        return out
    for m in SPELLED.finditer(low):
        said, times = "", 1
        for word in WORDS.findall(m.group()):
            if word == "plus":
                said += "+"
            elif word in TIMES:
                times = TIMES[word]
            else:
                said, times = said + str(DIGITS[word]) * times, 1
        out.append((*m.span(), said))
    return out


def brackets(text: str) -> list[tuple[int, int, str]]:
    low, out = lowered(text), []
    for m in BRACKETED.finditer(low):
        start = m.start()
        while start and m.start() - start < 2 and low[start - 1] in " \t":
            start -= 1
        out.append((start, m.end(), "@" if m["at"] else "."))
    return out + [(*m.span(), "@" if m["at"] else ".") for m in REFERENCE.finditer(low)]


def plain_words(text: str) -> list[tuple[int, int, str]]:
    """``at`` and ``dot`` as words, in addresses and between four numbers."""
    low, out = lowered(text), []
    dots = lambda start, end: [(*d.span(), ".") for d in DOT_WORD.finditer(low, start, end)]
    for m in HANDLE_AT.finditer(low):
        before = low[max(0, m.start() - LOCAL_REACH) : m.start()]
        handle = before[len(before.rstrip(LOCAL)) :]
        if re.search(r"[a-z]", handle) and re.search(r"[0-9._%+-]", handle.strip(".-")):
            out.append((*m.span(), "@"))
    if any(w in low for w in DOT_WORDS):
        for m in PLAIN_AT.finditer(low):
            if m.start() and not low[m.start() - 1].isspace():
                out += [(*m.span(), "@"), *dots(m.end(), m.end(1))]
                reach = max(0, m.start() - LOCAL_REACH)
                if said := LOCAL_DOT.search(low[reach : m.start()].rstrip(LOCAL)):
                    out += dots(reach + said.start(), reach + said.end())
        for m in SIGN_DOT.finditer(low):
            out += dots(m.end(), m.end(1))
        for m in FOUR.finditer(low):
            out += [(*d.span(), ".") for d in ANY_DOT.finditer(low, m.start(), m.end())]
    return out


TRANSDUCERS = (characters, spelled_digits, brackets, plain_words)


def normalised(text: str) -> tuple[str, list[list[Edit]]]:
    """The text behind the disguises and the edits of each transducer."""
    steps = []
    for step in TRANSDUCERS:
        text, edits = rewritten(text, step(text)) if (changes := step(text)) and changes else (text, [])
        steps.append(edits)
    return text, steps


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans (start, end, kind), in code points of ``text``."""
    text = text or ""
    base = identifiers(text)
    plain, steps = normalised(text)
    added: dict[Span, None] = {}
    for start, end, kind in identifiers(plain) if any(steps) else ():
        seen = False
        for edits in reversed(steps):
            seen |= touched(edits, start, end)
            start, end = source(edits, start, end)
        if seen:
            added[start, end, kind] = None
    base_starts = [b[0] for b in base]
    furthest = []  # the furthest end of the base spans so far
    for b in base:
        furthest.append(max(b[1], furthest[-1] if furthest else 0))

    def inside(s: Span) -> bool:
        k = bisect_right(base_starts, s[0]) - 1
        return k >= 0 and furthest[k] >= s[1]

    return base, [s for s in added if not inside(s)]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
NEW = ("spans", "redacted")


def find_pii(docs: DataFrame, text_col: str = "text", redact: bool = True) -> DataFrame:
    """``docs`` with spans (kind, start, end in code points, base) by start and kind, and, unless ``redact`` is false, redacted:
    the text with ``<kind>`` in each span's place (overlapping spans as one, under the first one's kind)."""
    new = NEW if redact else NEW[:1]
    work, column, kept = numbered(docs, new)
    text = column(text_col)
    work = work.withColumn("text", F.col(text).cast("string"))
    shown = [k for k, _ in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                spans, texts = [], []
                for t in batch.column("text").to_pylist():
                    base, added = find(t)
                    found = sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                    spans.append([{"kind": k, "start": a, "end": b, "base": is_base} for a, b, k, is_base in found])
                    if redact:
                        texts.append(redacted(t, found))
                made = [pa.array(spans, SPANS), *([pa.array(texts, pa.string())] if redact else [])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in shown), *made], names=[*shown, *new])

    kinds = {f.name: f.dataType.simpleString() for f in work.schema.fields}
    added = ["spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>", "redacted string"][: len(new)]
    return restored(work.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in shown), *added])), kept, new)


def redacted(text: str | None, spans: list[tuple]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind, *_ in spans:
        if start >= at:
            out += (text[at:start], f"<{kind}>")
        at = max(at, end)
    return "".join([*out, text[at:]])


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
