r"""Personal data with offset-preserving deobfuscation.

Identifiers are found twice. On the text as it is, four fixed grammars (email, ip, card,
phone) give the base spans. Then a chain of transducers rewrites the text - homoglyphs and
full-width forms to ASCII, invisible characters to nothing, spelled digits to digits, at and
dot disguises to @ and . - and keeps, for every character written, the source span it came
from. The same grammars run on the rewritten text; a match that holds at least one rewritten
character is mapped back to its source characters and added, unless a base span of its kind
already covers it. Base spans always stay.

Bare words such as ` at ` and ` dot ` are common in running text, so they count only together
(name at host dot domain), and spelled digits only in runs of at least four that hold two names besides the articles,
or as four octets with dots between them.

Offsets are code points, ends exclusive. Defined results: a null text is the empty text and
has no spans; spans of different kinds may overlap; redaction merges overlapping spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import field, with_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A number starts where no digit stands before it; the look-behind follows the first digit so that the search can skip to digits.
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            last = m.end()
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) < 256 for part in m[0].split("."))]


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


_FINDERS = dict(zip(KINDS, (_emails, _ips, _cards, _phones), strict=True))


def detect(text: str) -> list[Span]:
    """Spans by kind as listed, then start."""
    return [(kind, a, b) for kind, find in _FINDERS.items() for a, b in find(text)]


# Letters of other scripts that look like ASCII letters, in pairs.
_LOOKALIKES = "аa еe оo рp сc уy хx іi јj ѕs ԁd ԛq ԝw һh ӏl ɡg ııi ɑa οo αa νv ρp τt υu κk ιi χx А A ВB ЕE КK МM НH ОO РP СC ТT ХX УY ІI ЈJ ЅS ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
_HOMOGLYPHS = {p[0]: p[-1] for p in _LOOKALIKES.split() if len(p) > 1} | {"А": "A"}
_HOMOGLYPHS |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
_HOMOGLYPHS |= {chr(base + d): str(d) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_HOMOGLYPHS |= {"﹫": "@", "﹒": ".", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹢": "+", " ": " ", " ": " ", " ": " ", " ": " ", "　": " "}
_HOMOGLYPHS |= dict.fromkeys("​‌‍⁠﻿­‎‏᠎", "")
_HOMOGLYPH = re.compile("[" + "".join(map(re.escape, _HOMOGLYPHS)) + "]")

# The digits' names in English, German, French and Spanish.
_DIGIT_NAMES = (
    "zero oh null cero zéro",
    "one eins ein un uno une",
    "two zwei zwo deux dos",
    "three drei trois tres",
    "four vier quatre cuatro",
    "five fünf fuenf cinq cinco",
    "six sechs seis",
    "seven sieben sept siete",
    "eight acht huit ocho",
    "nine neun neuf nueve",
)
_DIGITS = {name: str(d) for d, names in enumerate(_DIGIT_NAMES) for name in names.split()}
_NAME = "(?:" + "|".join(sorted(map(re.escape, _DIGITS), key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?<!\w)(?:{_NAME}|\d)(?:(?:[ ,.-]|, |[ ]?\([ ]?|[ ]?\)[ ]?)(?:{_NAME}|\d+))*(?!\w)", re.I)
_ONE_NAME = re.compile(rf"(?<!\w){_NAME}(?!\w)", re.I)
_PLUS = re.compile(r"(?<!\w)plus[ ](?=\d)", re.I)

_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_AT_WORD, _DOT_WORD = r"(?:at|arroba|ät|chez|@)", r"(?:dot|punkt|punto|point|d0t|\.)"
_BOXED_AT = re.compile(rf"\s?{_OPEN}\s?{_AT_WORD}\s?{_SHUT}\s?|(?<=\w)\s?[_*]at[_*]\s?(?=\w)|(?<=[\w.%+-])\s?&#(?:64|x40);\s?(?=\w)", re.I)
_BOXED_DOT = re.compile(rf"\s?{_OPEN}\s?{_DOT_WORD}\s?{_SHUT}\s?|(?<=\w)\s?[_*]dot[_*]\s?(?=\w)|(?<=\w)\s?&#(?:46|x2e);\s?(?=\w)", re.I)
_BARE = re.compile(r"(?<![\w.%+-])(?:[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+| (?:dot|punkt|punto|point) [A-Za-z0-9_%+-]+)*)( ?@ ?| at | arroba )[A-Za-z0-9-]+((?:(?: (?:dot|punkt|punto|point) |\.| \. )[A-Za-z0-9-]+)+)(?![\w-])", re.I)
_BARE_DOT = re.compile(r" (?:dot|punkt|punto|point) | \. ", re.I)
_IP_WORDS = re.compile(r"(?<![\w.])\d{1,3}(?:(?: ?(?:dot|punkt|punto|point) ?| \. |\.)\d{1,3}){3}(?![\w.]*\d)", re.I)
_BETWEEN_OCTETS = re.compile(r"(?<=\d)(?: ?(?:dot|punkt|punto|point) ?| \. |\.)(?=\d)", re.I)
#: Four octets of one to three digits, by name or as figures, with dots between them by name, in brackets or as they are.
_OCTET, _OCTET_DOT = rf"(?:{_NAME}|\d)(?:[ -]?(?:{_NAME}|\d)(?!\w)|\d){{0,2}}(?!\w)", rf"(?: (?:dot|punkt|punto|point) | ?{_OPEN} ?{_DOT_WORD} ?{_SHUT} ?| ?\. ?)"
_SPELLED_IP = re.compile(rf"(?<![\w.]){_OCTET}(?:{_OCTET_DOT}{_OCTET}){{3}}(?!\.?\w)", re.I)
_SPELLED_OCTET = re.compile(_OCTET, re.I)
_BOX_HINT = re.compile(r"[\[({<_*]\s?(?:[aAcC][tTrRhH]|ä|Ä|@|[dDpP][oO0uU]|\.)")
#: Names that are no articles; a spelled run needs two of them.
_NAMES = frozenset(_DIGITS) - {"un", "une", "ein", "uno"}


class Rewriter:
    """A text under rewriting: pieces of the current text and where each came from.

    starts[i] is where piece i begins in the current text, sources[i] the source span it
    stands for; inside an unchanged piece, characters match one to one.
    """

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.sources, self.changed = text, [0], [(0, len(text))], [False]

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, written) in the current text, ascending and apart."""
        if not edits:
            return
        out, starts, sources, changed, at, size = [], [], [], [], 0, 0

        def put(text: str, source: tuple[int, int], new: bool) -> None:
            nonlocal size
            starts.append(size)
            sources.append(source)
            changed.append(new)
            out.append(text)
            size += len(text)

        def keep(a: int, b: int) -> None:
            """Carries a to b over, with the empty pieces (removed characters) from a up to and at b."""
            k = bisect_left(self.starts, a)
            if k == len(self.starts) or self.starts[k] > a:
                k -= 1
            while k < len(self.starts) and self.starts[k] <= b:
                begin = self.starts[k]
                end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
                x, y = max(a, begin), min(b, end)
                lo, hi = self.sources[k]
                if x < y or begin == end and self.changed[k]:
                    put(self.text[x:y], (lo, hi) if self.changed[k] else (lo + x - begin, lo + y - begin), self.changed[k])
                k += 1

        for a, b, written in edits:
            keep(at, a)
            put(written, (self.source(a, a + 1)[0], self.source(b - 1, b)[1]), True)
            at = b
        keep(at, len(self.text))
        self.text, self.starts, self.sources, self.changed = "".join(out), starts or [0], sources or [(0, 0)], changed or [False]

    def _piece(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def source(self, a: int, b: int) -> tuple[int, int]:
        """Source span of the current characters a to b (at least one)."""
        i, j = self._piece(a), self._piece(b - 1)
        lo = self.sources[i][0] if self.changed[i] else self.sources[i][0] + a - self.starts[i]
        hi = self.sources[j][1] if self.changed[j] else self.sources[j][0] + b - self.starts[j]
        return lo, hi

    def rewritten(self, a: int, b: int) -> bool:
        return any(self.changed[self._piece(a) : self._piece(b - 1) + 1])


def _plain(text: str) -> str:
    """Lower case as the patterns see it: they take the long s for an s."""
    return text.lower().replace("\u017f", "s")


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        names = list(_ONE_NAME.finditer(text, m.start(), m.end()))
        digits = len(names) + sum(c.isdigit() for c in m[0])
        if digits >= 4 and sum(_plain(n[0]) in _NAMES for n in names) >= 2:
            edits += [(n.start(), n.end(), _DIGITS[_plain(n[0])]) for n in names]
    return edits


def _octet_edits(text: str) -> list[tuple[int, int, str]]:
    """Octets of spelled addresses become figures; the dots between them are left to the dot rewriting."""
    edits = []
    for m in _SPELLED_IP.finditer(text):
        if not any(_plain(n[0]) in _NAMES for n in _ONE_NAME.finditer(m[0])):
            continue
        for o in _SPELLED_OCTET.finditer(text, m.start(), m.end()):
            written = _ONE_NAME.sub(lambda n: _DIGITS[_plain(n[0])], o[0]).replace(" ", "").replace("-", "")
            if written != o[0]:
                edits.append((o.start(), o.end(), written))
    return edits


def _bare_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _BARE.finditer(text):
        sign = m[1].strip().lower()
        dots = list(_BARE_DOT.finditer(text, m.start(2), m.end(2)))
        worded = any(d[0].strip() != "." for d in dots)
        if sign != "@" and not worded:
            continue
        if sign == "@" and m[1] == "@" and not dots:
            continue
        edits += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(text, m.start(), m.start(1))]
        edits.append((m.start(1), m.end(1), "@"))
        edits += [(d.start(), d.end(), ".") for d in dots]
    return edits


def _ip_edits(text: str) -> list[tuple[int, int, str]]:
    return [(d.start(), d.end(), ".") for m in _IP_WORDS.finditer(text) for d in _BETWEEN_OCTETS.finditer(text, m.start(), m.end()) if d[0] != "."]


def _has_lookalike(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _HOMOGLYPH.search(text) is not None
    return "\xa0" in text or "\xad" in text


#: What each transducer can't do without; the searches skip texts where it would find nothing, and no others.
_ANY_WORD = re.compile(r"\w+")
_SPACED_DOT = re.compile(r"\d \. \d")
_DOT_NAME = re.compile("dot|punkt|punto|point", re.I)


def _spells(text: str) -> bool:
    """Whether a digit's name that is no article stands in the text as a word."""
    return not _NAMES.isdisjoint(_ANY_WORD.findall(_plain(text)))


def normalise(text: str) -> Rewriter:
    """The whole chain of transducers; texts without a disguise come back as they are."""
    r = Rewriter(text)
    if _has_lookalike(text):
        r.apply([(m.start(), m.end(), _HOMOGLYPHS[m[0]]) for m in _HOMOGLYPH.finditer(text)])
    if _spells(r.text):
        r.apply(_octet_edits(r.text))
        r.apply(_spelled_edits(r.text))
    if "plus " in r.text.lower():
        r.apply([(m.start(), m.end(), "+") for m in _PLUS.finditer(r.text)])
    if "&#" in r.text or _BOX_HINT.search(r.text):
        r.apply([(m.start(), m.end(), "@") for m in _BOXED_AT.finditer(r.text)])
        r.apply([(m.start(), m.end(), ".") for m in _BOXED_DOT.finditer(r.text)])
    named, lowered = _DOT_NAME.search(r.text) is not None, r.text.lower()
    if "@" in lowered and (named or " @" in lowered or "@ " in lowered or " . " in lowered) or named and (" at " in lowered or " arroba " in lowered):
        r.apply(_bare_edits(r.text))
    if named or _SPACED_DOT.search(r.text):
        r.apply(_ip_edits(r.text))
    return r


def find_private(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by kind as listed, then start."""
    base = detect(text)
    r = normalise(text)
    if len(r.starts) == 1:
        return base, base
    found = {*base}
    for kind, a, b in detect(r.text):
        if r.rewritten(a, b):
            lo, hi = r.source(a, b)
            if not any(k == kind and x <= lo and hi <= y for k, x, y in base):
                found.add((kind, lo, hi))
    return base, sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, becomes the first one's kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = [field(f"n_{k}", T.LongType()) for k in KINDS] + [
    field("base_sha256", T.StringType()),
    field("spans", T.StringType()),
    field("n_spans", T.LongType()),
    field("redacted", T.StringType()),
]


def find_pii(docs: DataFrame, text_col: str = "text", with_redacted: bool = True) -> DataFrame:
    """docs with counts of base spans by kind, their digest, all spans and their number, and the text without them (null if not asked for)."""

    def make():
        def work(batch: pa.RecordBatch) -> list:
            out = [[] for _ in RESULT]
            for value in batch.column(batch.schema.get_field_index(text_col)):
                text = value.as_py() or ""
                base, spans = find_private(text)
                row = [sum(s[0] == k for s in base) for k in KINDS]
                row += [hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans), len(spans), redact(text, spans) if with_redacted else None]
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            return out

        return work

    return with_columns(docs, RESULT, make)
