"""Personal data: transducers undo disguises, detectors read the normalised text, spans go back to the source."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

# --- detectors -------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that begins inside a run of digits could begin earlier, so only the run's first digit is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches around each @: the local part reaches back to the match before it at most."""
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            free = end.end()
            found.append((start, free))
        at = text.find("@", max(at + 1, free))
        free = max(free, 0)
    return found


def detect(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all identifiers, leftmost and non-overlapping within a kind, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) < 4 and int(part) < 256 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 11:
            digits = m[0].translate(_DIGITS)
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(m[0].translate(_DIGITS)) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- transducers -----------------------------------------------------------------------------------------

class Trace:
    """A text under rewriting that knows for each of its characters which source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.stages = text, []

    def rewrite(self, pattern: re.Pattern, into: Callable[[re.Match], list[tuple[int, int, str]]]) -> None:
        """Replaces the ``(start, end, text)`` pieces that ``into`` names for each match, in order."""
        pieces, before, here, last = [], [], [], 0
        out = 0
        for m in pattern.finditer(self.text):
            for start, end, new in into(m):
                pieces += [self.text[last:start], new]
                out += start - last
                before.append((out, out + len(new)))
                here.append((start, end))
                out, last = out + len(new), end
        if here:
            pieces.append(self.text[last:])
            self.text = "".join(pieces)
            self.stages.append(([a for a, _ in before], before, here))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of the characters from ``start`` to ``end``."""
        for firsts, now, was in reversed(self.stages):
            start, end = self._back(firsts, now, was, start)[0], self._back(firsts, now, was, end - 1)[1]
        return start, end

    @staticmethod
    def _back(firsts, now, was, at) -> tuple[int, int]:
        k = bisect_right(firsts, at) - 1
        while k >= 0 and now[k][0] == now[k][1] and k > 0 and now[k - 1][1] > at:  # an empty piece at the same place
            k -= 1
        if k < 0:
            return at, at + 1
        if at < now[k][1]:
            return was[k]
        at += was[k][1] - now[k][1]
        return at, at + 1


# Letters of other scripts that look like ASCII ones (Cyrillic, then Greek, then Latin forms).
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o",
    "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "и": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T",
    "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʟ": "l", "ᴏ": "o", "ѡ": "w", "ո": "n", "ս": "u", "օ": "o", "հ": "h",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹘": "-", "․": ".", "。": ".", "｡": ".", "·": ".", "•": ".", "∙": ".",
    "˖": "+", "➕": "+",
}
_BEYOND = re.compile("[^\x00-\x7f\xc0-\xff]")
#: Characters that show nothing.
_UNSEEN = re.compile("[­͏᠎​-‏⁠-⁤︀-️﻿]+")


def plain(char: str) -> str:
    """The ASCII character that ``char`` looks like; itself where there is none."""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if unicodedata.category(char) == "Zs":
        return " "
    if (digit := unicodedata.digit(char, None)) is not None:
        return str(digit)
    wide = unicodedata.normalize("NFKC", char)
    return wide if len(wide) == 1 and wide.isascii() else char


class _Plain(dict):
    """``plain`` remembered, for characters beyond ASCII and the letters of Latin-1, which never change."""

    def __missing__(self, char: str) -> str:
        self[char] = value = plain(char)
        return value


_PLAIN = _Plain()

# Digits as English, German, French and Spanish words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w))) + ")"
_DOT, _AT = "(?:dot|punkt|punto|point)", "(?:at|arroba|chez|bei)"
_OPEN, _CLOSE = r"[\[({<|_*~-]{1,2}", r"[\])}>|_*~-]{1,2}"
_EDGE = r"(?<![^\W\d_])"  # no letter before
_DASH = "(?:dash|hyphen|minus)"
_GAP = rf"(?:\s{_DOT}\s|\s{_DASH}\s|[\x20,/()-]{{1,3}})"
_NUMBER = re.compile(rf"{_EDGE}(?:{_WORD}(?![^\W_])|(?<!\d)\d++)(?:{_GAP}(?:{_WORD}|\d++)(?![^\W\d_]))++", re.I)
_PIECE = re.compile(rf"(?P<dot>\s{_DOT}\s)|(?P<dash>\s{_DASH}\s)|(?P<word>{_WORD})|(?P<digits>\d+)|(?P<gap>[\x20,/()-]+)", re.I)
_PLUS = re.compile(r"(?<!\w)(?:\(plus\)|\[plus\]|plus)\s{0,2}(?=[0-9(])", re.I)
_BETWEEN = re.compile(rf"(?<=[0-9])\s?(?:\[\.\]|\(\.\)|{{\.}}|{_OPEN}\s?{_DOT}\s?{_CLOSE}|\s{_DOT}\s|\s\.\s)\s?(?=[0-9])", re.I)
_LIKE_DIGITS = re.compile(  # begins where no such group goes on, so a long one is read once
    r"(?<![^\W_])(?<![0-9OoIl][ ().+-])(?<![0-9OoIl][ ().+-]{2})(?<![0-9OoIl][ ().+-]{3})[0-9OoIl](?:[ ().+-]{0,3}[0-9OoIl])*(?![^\W\d_])")
_SIGN = re.compile(r"&(?:#0{0,4}64|#x0{0,4}40|commat);|&(?:#0{0,4}46|#x0{0,4}2e|period);|%40", re.I)
_BRACKET_AT = re.compile(rf"\s?{_OPEN}\s?(?:{_AT}|@)\s?{_CLOSE}\s?|(?<=[A-Za-z0-9])\s{{1,2}}@\s{{0,2}}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@\s{{1,2}}(?=[A-Za-z0-9])", re.I)
_BRACKET_DOT = re.compile(rf"\s?{_OPEN}\s?(?:{_DOT}|\.)\s?{_CLOSE}\s?", re.I)
_NAME = r"[A-Za-z0-9_%+-]{1,64}+"
# name [dot name] at|@ name dot name: with a bare "at" at least one dot of the domain is spelled too
_SPELLED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:\s{_DOT}\s{_NAME}){{0,8}}(?:\s{_AT}\s|@)"
    rf"(?:[A-Za-z0-9-]{{1,64}}+\.){{0,8}}[A-Za-z0-9-]{{1,64}}+(?:\s{_DOT}\s[A-Za-z0-9-]{{1,64}}+(?:\.[A-Za-z0-9-]{{1,64}}+){{0,8}}){{1,8}}", re.I)
_MIXED = re.compile(  # name.name at name.name: a bare "at" between parts that both look like an address
    rf"(?<![A-Za-z0-9._%+-])(?=[A-Za-z_%+-]*[0-9._])[A-Za-z0-9._%+-]{{1,64}}+(?<![.])\s{_AT}\s(?:[A-Za-z0-9-]{{1,64}}+\.){{1,8}}[A-Za-z]{{2,24}}(?![A-Za-z0-9-])", re.I)
_TOKEN = re.compile(rf"\s{_DOT}\s|\s{_AT}\s", re.I)
_EMAIL_DOT = re.compile(r"(?<=@)[A-Za-z0-9-]{1,64}+(?:(?:\.|\s\.\s)[A-Za-z0-9-]{1,64}+){1,8}")
_SPACED_DOT = re.compile(r"\s\.\s")
#: Endings of addresses that are taken where at and dot are bare words. Fixed values.
ENDINGS = frozenset("""com org net edu gov mil int info biz io ai app dev co me tv example test invalid local internal
at be br ca ch cn cz de dk es eu fi fr gr hu ie il in it jp kr mx nl no nz pl pt ro ru se tr ua uk us za""".split())

_LETTERS_DIGITS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_DIGIT_TOKENS = frozenset(w.encode() for w in DIGIT_WORDS)
_DOT_TOKENS, _AT_TOKENS = {b"dot", b"punkt", b"punto", b"point"}, {b"at", b"arroba", b"chez", b"bei"}
_HAS_BRACKET = re.compile(rf"[\[({{<|_*~-]\s?(?:{_DOT}|{_AT}|[.@])\s?[\])}}>|_*~-]", re.I)
_HAS_MIXED = re.compile(rf"\s{_AT}\s[A-Za-z0-9-]+\.[A-Za-z0-9]", re.I)
_HAS_LIKE = re.compile(r"[0-9](?:(?<=[OoIl][0-9])|[OoIl])")

def _number(m: re.Match) -> list[tuple[int, int, str]]:
    """Digits for words; a gap between two parts goes where one of them is a word."""
    parts = [(p.lastgroup, p.start() + m.start(), p.end() + m.start(), p[0]) for p in _PIECE.finditer(m[0])]
    out = []
    for k, (kind, start, end, text) in enumerate(parts):
        if kind == "word":
            out.append((start, end, DIGIT_WORDS[text.lower()]))
        elif kind in ("dot", "dash"):
            out.append((start, end, "." if kind == "dot" else "-"))
        elif kind == "gap" and "word" in (parts[k - 1][0], parts[min(k + 1, len(parts) - 1)][0]):
            out.append((start, end, ""))
    return out


def _whole(new: str) -> Callable[[re.Match], list[tuple[int, int, str]]]:
    return lambda m: [(m.start(), m.end(), new)]


def _tokens(m: re.Match) -> list[tuple[int, int, str]]:
    return [(t.start() + m.start(), t.end() + m.start(), "@" if t[0].strip().lower().encode() in _AT_TOKENS else ".")
            for t in _TOKEN.finditer(m[0])]


def _bare(m: re.Match) -> list[tuple[int, int, str]]:
    """Bare words for at and dot count where the last part is a usual ending; an @ needs none."""
    last = re.split(r"[.\s]", m[0])[-1].lower()
    return _tokens(m) if "@" in m[0] or last in ENDINGS else []


def _digits_again(m: re.Match) -> list[tuple[int, int, str]]:
    """Letters that look like digits and touch one, in a group that is mostly digits."""
    group = m[0]
    if 2 * sum(c.isdigit() for c in group) < len(group.replace(" ", "")):
        return []
    near = f"{m.string[max(m.start() - 1, 0)] if m.start() else ' '}{group} "
    return [(m.start() + k, m.start() + k + 1, "0" if c in "Oo" else "1") for k, c in enumerate(group)
            if c in "OoIl" and (near[k].isdigit() or near[k] == "+" or near[k + 2].isdigit())]


def normalise(text: str) -> Trace | None:
    """The text without disguises, or None where nothing suggests one. Each transducer runs only on texts that hold its signs."""
    trace, changed = Trace(text), False
    if _BEYOND.search(text):
        table = {ord(c): _PLAIN[c] for c in set(text) if c > "\x7f" and not "\xc0" <= c <= "\xff" and _PLAIN[c] != c}
        if table:  # one character for one, so places stay
            trace.text, changed = text.translate(table), True
        trace.rewrite(_UNSEEN, _whole(""))
    if "&" in text or "%40" in text:
        trace.rewrite(_SIGN, lambda m: [(m.start(), m.end(), "@" if m[0].lower() in ("%40", "&commat;") or "64" in m[0] or "40" in m[0] else ".")])
    tokens = trace.text.encode("utf-8", "replace").translate(_LETTERS_DIGITS).split()
    seen = set(tokens)
    brackets = bool(_HAS_BRACKET.search(trace.text))
    dot, at = not seen.isdisjoint(_DOT_TOKENS), not seen.isdisjoint(_AT_TOKENS)
    if brackets or "@" in trace.text:
        trace.rewrite(_BRACKET_AT, _whole("@"))
    if brackets:
        trace.rewrite(_BRACKET_DOT, _whole("."))
    if not seen.isdisjoint(_DIGIT_TOKENS):
        number = [t in _DIGIT_TOKENS or t.isdigit() for t in tokens]
        if dot or any(x and y for x, y in zip(number, number[1:])):
            trace.rewrite(_NUMBER, _number)
    if _HAS_LIKE.search(trace.text):
        trace.rewrite(_LIKE_DIGITS, _digits_again)
    if dot or brackets or " . " in trace.text:
        trace.rewrite(_BETWEEN, _whole("."))
    if b"plus" in seen:
        trace.rewrite(_PLUS, _whole("+"))
    if dot and (at or "@" in trace.text):
        trace.rewrite(_SPELLED, _bare)
    if at and _HAS_MIXED.search(trace.text):
        trace.rewrite(_MIXED, _bare)
    if "@" in trace.text and " . " in trace.text:
        trace.rewrite(_EMAIL_DOT, lambda m: [(d.start() + m.start(), d.end() + m.start(), ".") for d in _SPACED_DOT.finditer(m[0])])
    return trace if trace.stages or changed else None


def find_spans(text: str | None) -> list[tuple[str, int, int, str, bool]]:
    """``(kind, start, end, value, plain)`` by start, then kind; ``plain`` where the source itself matches."""
    text = text or ""
    base = detect(text)
    spans = [(a, k, b, text[a:b], True) for a, k, b in base]
    trace = normalise(text)
    if trace:
        seen = {(k, a, b) for a, k, b in base}
        held = {k: [(a, b) for a, kind, b in base if kind == k] for k in range(len(KINDS))}
        for a, k, b in detect(trace.text):
            start, end = trace.source(a, b)
            if (k, start, end) in seen:
                continue
            at = bisect_right(held[k], (start, len(text))) - 1
            if at >= 0 and held[k][at][0] <= start and end <= held[k][at][1]:
                continue  # part of one that the source shows plainly
            seen.add((k, start, end))
            spans.append((start, k, end, trace.text[a:b], False))
    return [(KINDS[k], a, b, value, shown) for a, k, b, value, shown in sorted(spans)]


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                      T.StructField("value", T.StringType()), T.StructField("plain", T.BooleanType())])


@F.pandas_udf(T.ArrayType(_SPAN))
def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([find_spans(t) for t in batch], dtype="object")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` of every document: e-mail and IP addresses, card and phone numbers.

    A span has ``kind``, ``start`` and ``end`` (code points of the source text, end exclusive), ``value`` (the
    identifier as read) and ``plain`` (whether the source itself matches, or only the text without disguises).
    Transducers remove unseen characters, map characters that look like ASCII ones, digits as words (English,
    German, French, Spanish), signs as entities, spelled or bracketed at, dot, dash and plus; each remembers where its output came
    from. The same detectors read the result, and what they find is mapped back. A bare "at" counts only
    where a dot of the domain is spelled too, or both sides look like parts of an address. Spans of one kind do not overlap
    among the plain ones; a disguised one inside a plain one of its kind is left out, a longer one is added.

    Every text is read whole and by itself; nothing is shuffled. Null and empty texts have no spans. Repeated rows and
    null ids stay rows. Further columns of ``docs`` are ignored. An empty table gives no rows.
    """
    return docs.select(F.col(id_col).alias("id"), _spans(F.col(text)).alias("spans")).select(F.col("id").alias(id_col), "spans")
