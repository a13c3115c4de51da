"""Personal data, disguised or plain: transducers that remember where each character came from."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import batches, per_text
from glyphmill.plans.session import ship_package

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = done = m.end()
            out.append((start, end))
        at = text.find("@", end)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


_FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}
_HAS_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Plain identifiers by kind, then start; leftmost, not overlapping within a kind."""
    digits = _HAS_DIGIT.search(text) is not None
    return [(kind, s, e) for kind in KINDS if digits or kind == "email" for s, e in _FINDERS[kind](text)]


# ---- transducers -------------------------------------------------------------------------------

#: Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKE = dict(zip("аеорсухіјѕԁһԛԝкмтвнАЕОРСУХІЈЅКМТВНαοντικρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwkmtbhAEOPCYXIJSKMTBHaovtikpABEZHIKMNOPTYX", strict=True))
#: Signs that stand for those of an identifier.
_SIGN = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "­": "", "。": ".", "·": ".", "․": ".", "∙": ".", "・": ".", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "＠": "@", "﹫": "@"}


def _fold_char(c: str) -> str:
    if c in _SIGN:
        return _SIGN[c]
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    if c.isspace():
        return " " if c not in "\n\r\t\v\f" else c
    try:
        return str(unicodedata.decimal(c))
    except ValueError:
        pass
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) < 4 and plain.isascii() else c


class _Folds(dict):
    """Code point to its plain form, made on demand; letters of written languages such as é stay."""

    def __missing__(self, code: int) -> str:
        out = self[code] = chr(code) if code < 128 else _fold_char(chr(code))
        return out


FOLDS = _Folds()
_NON_ASCII = re.compile(r"[^\x00-\x7f¡-§©«-¬®°-±¶»¿-ɏ]")


class Normal:
    """A normalised text and, for each of its characters, the source span that it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, put, spaces: bool = False) -> None:
        """Replaces each match by ``put`` of its text; None leaves it. With ``spaces``, those around a match go too."""
        found, done, text = [], 0, self.text
        for m in pattern.finditer(text):
            a, b = m.span()
            if a == b or (new := put(m[0])) is None:
                continue
            if spaces:
                while a > done and text[a - 1] == " ":
                    a -= 1
                while b < len(text) and text[b] == " ":
                    b += 1
            found.append((a, b, new))
            done = b
        self.replace(found)

    def replace(self, found: list[tuple[int, int, str]]) -> None:
        """Puts new text for spans, which are in order; every character of it stands for the whole span."""
        out, start, end, at = [], [], [], 0
        for a, b, new in found:
            out += (self.text[at:a], new)
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        if at:
            self.text = "".join(out) + self.text[at:]
            self.start = start + self.start[at:]
            self.end = end + self.end[at:]

    def fold(self) -> None:
        self.rewrite(_NON_ASCII, lambda x: None if (c := FOLDS[ord(x)]) == x else c)


#: Digits spelled in the languages of the texts.
_SPELLED = {
    **{w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())},
    **{w: str(i) for i, w in enumerate("null eins zwei drei vier fünf sechs sieben acht neun".split())},
    **{w: str(i) for i, w in enumerate("zéro un deux trois quatre cinq six sept huit neuf".split())},
    **{w: str(i) for i, w in enumerate("cero uno dos tres cuatro cinco seis siete ocho nueve".split())},
    "oh": "0",
    "zwo": "2",
}
_WORD = "|".join(sorted(map(re.escape, _SPELLED), key=len, reverse=True))
_DIGIT_RUN = re.compile(rf"(?i)(?<!\w)(?:plus[ ,-]+)?(?:{_WORD}|[0-9])(?:(?:[ ,-]+|[ ]*\([ ]*|[ ]*\)[ ]*|[ ]+(?:dot|punkt|point|punto)[ ]+|\.)(?:{_WORD}|[0-9]+))+(?!\w)")
_ONE_WORD = re.compile(rf"(?i)(?<!\w)(?:{_WORD})(?!\w)")
_SPELLED_PAIR = re.compile(rf"(?i)(?<!\w)(?:{_WORD})(?:[ ,-]+|[ ]+(?:dot|punkt|point|punto)[ ]+)(?:{_WORD}|[0-9])(?!\w)")
_DOT_NAMES = "dot|punkt|point|punto"
_DOTS = frozenset(_DOT_NAMES.split("|"))
#: Brackets are looked for first and the spaces around them taken afterwards, so that runs of spaces are read once.
_OPEN, _CLOSE = r"[\(\[\{<][ ]*+", r"[ ]*+[\)\]\}>]"
_AT_BRACKETED = re.compile(rf"(?i){_OPEN}(?:at|@|arroba|ät){_CLOSE}")
_DOT_BRACKETED = re.compile(rf"(?i){_OPEN}(?:{_DOT_NAMES}|\.){_CLOSE}")
_MARKED = re.compile(rf"(?i)(?<=[A-Za-z0-9])(?:[_-]+(at|arroba)[_-]+|[_-]+(?:{_DOT_NAMES})[_-]+)(?=[A-Za-z0-9])")
#: A bare address is found from its "at" outwards: the domain after it, then the local part before it, which may be spelled with dots too.
_AT_SIGN = re.compile(r"(?i) (?:at|arroba)(?= )|@")
_BARE_DOMAIN = re.compile(rf"(?i)[ ]*+[A-Za-z0-9-]++(?:(?:[ ]++(?:{_DOT_NAMES})[ ]++|\.)[A-Za-z0-9-]++)++")
_BARE_PART = re.compile(rf"(?i)[ ]+(?:(at|arroba)|(?:{_DOT_NAMES}))[ ]+|[ ]*(@)[ ]*")
#: Endings that a domain spelled in bare words must have; prose has "at" and "dot" too.
_ENDINGS = frozenset("com org net edu gov mil int info biz name io ai app dev co me tv eu us uk ca au nz de at ch fr be nl lu es pt it mx ar br cl pl cz se no dk fi ie in jp cn kr ru tr za example test invalid local".split())
_BARE_DOT = re.compile(rf"(?i)[ ](?:{_DOT_NAMES})[ ]")
_SPACED_AT = re.compile(r"[A-Za-z0-9][ ]+@[ ]*[A-Za-z0-9]|[A-Za-z0-9]@[ ]+[A-Za-z0-9]")
_DOTTED_NUMBER = re.compile(rf"(?i)(?<![0-9])[0-9]{{1,3}}(?:[ ]+(?:{_DOT_NAMES})[ ]+[0-9]{{1,3}}|[ ]*\.[ ]*[0-9]{{1,3}}){{3}}(?![0-9])")
_CARD_SIGNS = re.compile(r"(?<![0-9.])[0-9]{3,6}(?:[._/][0-9]{3,6}){2,5}(?![0-9.])")


def _digits(run: str) -> str | None:
    """A run of spelled or plain digits, if it has two spelled ones at least: spelled words become digits, names of signs the signs."""
    if len(_ONE_WORD.findall(run)) < 2:
        return None
    run = re.sub(rf"(?i)[ ]+(?:{_DOT_NAMES})[ ]+", ".", run)
    run = re.sub(r"(?i)^plus[ ,-]+", "+", run)
    run = _ONE_WORD.sub(lambda w: _SPELLED[w[0].lower()], run)
    return re.sub(r"[ ,-]+", "", run)


def normalised(text: str) -> Normal | None:
    """The text with disguises undone, or None where there are none to undo."""
    strange = _NON_ASCII.search(text) is not None
    folded = Normal(text)
    if strange:
        folded.fold()
    t = folded.text
    has = [
        _AT_BRACKETED.search(t) is not None,
        _DOT_BRACKETED.search(t) is not None,
        _MARKED.search(t) is not None,
        _BARE_DOT.search(t) is not None or _SPACED_AT.search(t) is not None,
        _SPELLED_PAIR.search(t) is not None,
        _CARD_SIGNS.search(t) is not None,
    ]
    if t == text and not any(has):
        return None
    if has[0]:
        folded.rewrite(_AT_BRACKETED, lambda _: "@", spaces=True)
    if has[1]:
        folded.rewrite(_DOT_BRACKETED, lambda _: ".", spaces=True)
    if has[2]:
        folded.rewrite(_MARKED, lambda x: "@" if x.strip("_-").lower() in ("at", "arroba") else ".")
    if has[4]:
        folded.rewrite(_DIGIT_RUN, _digits)
    if has[0] or has[2] or has[3]:
        folded.replace(bare_mails(folded.text))
        folded.rewrite(_DOTTED_NUMBER, lambda x: re.sub(r"[^0-9]+", ".", x))
    if has[5]:
        folded.rewrite(_CARD_SIGNS, lambda x: d if 13 <= len(d := _NOT_DIGIT.sub("", x)) <= 19 and luhn(d) else None)
    return folded


def bare_mails(text: str) -> list[tuple[int, int, str]]:
    """Spans of addresses with spaces around their signs or the signs' names, and the plain form of each."""
    out, done = [], 0
    for m in _AT_SIGN.finditer(text):
        if m.start() < done or not (domain := _BARE_DOMAIN.match(text, m.end())):
            continue
        start, at = None, m.start()
        while True:
            end = at
            while end > done and text[end - 1] == " ":
                end -= 1
            first = end
            while first > done and text[first - 1] in _LOCAL:
                first -= 1
            if first == end or (first and text[first - 1] in _LOCAL):
                break
            if start is not None:
                # what is before must be a part and the name of a dot, with spaces between
                if end == at or text[first:end].lower() not in _DOTS:
                    break
                at, last = first, first
                while last > done and text[last - 1] == " ":
                    last -= 1
                first = last
                while first > done and text[first - 1] in _LOCAL:
                    first -= 1
                if last == at or first == last or (first and text[first - 1] in _LOCAL):
                    break
            start = at = first
            if "." in text[first:end]:
                break
        if start is None:
            continue
        done = domain.end()
        if (plain := _plain_mail(text[start:done])) is not None:
            out.append((start, done, plain))
    return out


def _plain_mail(found: str) -> str | None:
    """A bare "at" counts only where a bare "dot" follows it ("meet at example.com" is prose), and bare words only if
    they end as a domain does."""
    if re.split(r"[ .]", found)[-1].lower() not in _ENDINGS:
        return None
    at = re.search(r"(?i)[ ](?:at|arroba)[ ]", found)
    if at and not _BARE_DOT.search(found, at.end() - 1):
        return None
    return _BARE_PART.sub(lambda p: "@" if p[1] or p[2] else ".", found)


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of disguised identifiers in the source text, without those that lie within a base span of their kind.

    An identifier counts only if undoing changed something within it or next to it: what the plain text
    already shows is left to the base rules.
    """
    normal = normalised(text)
    if normal is None:
        return []
    out = []
    plain = {kind: [(x, y) for k, x, y in base if k == kind] for kind in KINDS}
    for kind, s, e in base_spans(normal.text):
        a, b = normal.start[s], normal.end[e - 1]
        if text[a:b] == normal.text[s:e]:
            continue
        before = bisect_right(plain[kind], (a, len(text))) - 1  # spans of a kind don't overlap
        if before < 0 or plain[kind][before][1] < b:
            out.append((kind, a, b))
    return out


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base and added spans together; by kind as listed, then start."""
    base = base_spans(text)
    added = added_spans(text, base)
    both = sorted({*base, *added}, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if added else base
    return base, both


def redact(text: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind in brackets."""
    _, spans = all_spans(text)
    if not spans:
        return text
    out, done, end = [], 0, -1
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < end:
            done = end = max(end, e)
            continue
        out += (text[done:s], f"[{kind.upper()}]")
        done = end = e
    return "".join(out) + text[done:]


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal_data(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text: id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans,
    spans (all, as kind:start:end in code points, end exclusive, by kind and start) and n_added.

    Null and empty texts have no spans; one row out for each row in, whatever its id, repeated or not; an
    empty table gives an empty result; further columns aren't read. Texts of any length are read whole; no
    pattern starts with a run that the one before it has read already, so time grows with the length.
    """

    def start():
        def work(text: str) -> tuple:
            base, both = all_spans(text)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            return *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(both), len(both) - len(base)

        return work

    return per_text(df, id_col, text_col, start, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact_documents(df: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with personal data replaced in the text, and its length brought up to date.
    A null text stays null, an empty one empty; repeated rows stay repeated; further columns go along whatever
    their names; an empty table gives an empty result."""
    ship_package(df.sparkSession)
    place = df.columns.index(text_col)
    schema = df.schema

    def run(stream):
        for batch in batches(stream):
            texts = [t and redact(t) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    out = df.mapInArrow(run, schema)
    if length_col in df.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(schema[length_col].dataType))
    return out
