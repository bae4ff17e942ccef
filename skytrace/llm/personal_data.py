"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs and digits, schemes, and the cues of
identifiers. At each anchor a parser of its kind expands to the boundaries of a candidate, left and right, and validates it by
ranges, lengths and check digits. Parsers are deterministic and don't go back over what they have consumed, so time grows with the
text's length.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import slices

#: Kinds in the order of results. The first four are the base; the others are found by cues and schemes.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "hidden_email", "iban", "account", "ssn", "login", "ipv6")
Span = tuple[str, int, int]

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"[0-9]+(?:[ .-][0-9]+)*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
IBAN = re.compile(r"[\s:#.]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:[\s]*(?:number|no|nr|num|id|nummer)\b)?[\s:#.=]*([0-9](?:[ -]?[0-9]){5,17})(?![A-Za-z0-9])", re.I)
SSN = re.compile(r"(?:[\s]*(?:number|no)\b)?[\s:#.=]*([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.I)
LOGIN = re.compile(r"[^\s/?#@:<>\"']+:[^\s/?#@<>\"']+@(?=[A-Za-z0-9\[])")
HEX = "0123456789abcdefABCDEF:"
#: Cues of identifiers by kind; each is looked for in lower case, in capitals and with one capital, as a whole word.
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "kontonummer", "cuenta", "compte"),
    "ssn": ("ssn", "social security"),
}


def _wordlike(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isalnum()


def luhn(digits: str) -> bool:
    """The check of payment card numbers: from the right, each second digit counts twice, and the digit sums end in 0."""
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + twice) % 10 == 0


def _iban_valid(text: str) -> bool:
    """Country code and check digits go to the end, letters count from 10; the number leaves 1 on division by 97."""
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


class _Reader:
    """The spans of one text; keeps how far each kind has consumed it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans: list[Span] = []
        self.at_signs = self.numbers = self.colons = 0

    def email(self, at: int) -> None:
        """The local part is what stands before the sign, up to the end of the address or the sign before."""
        low = self.at_signs
        self.at_signs = at + 1
        start = low + len(self.text[low:at].rstrip(LOCAL))
        if start < at and (domain := DOMAIN.match(self.text, at + 1)):
            self.spans.append(("email", start, domain.end()))
            self.at_signs = domain.end()

    def number(self, at: int) -> None:
        """A stretch of digits with single dots, blanks and hyphens between holds dotted and card numbers."""
        if at < self.numbers:
            return
        m = NUMBER.match(self.text, at)
        self.numbers = m.end()
        if m.end() - at < 7:
            return
        stretch = m[0]
        self._dotted(stretch, at)
        self._cards(stretch, at)

    def _dotted(self, stretch: str, base: int) -> None:
        for chain in re.finditer(r"[0-9.]+", stretch):
            if chain[0].count(".") < 3:
                continue
            parts, place = chain[0].split("."), base + chain.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = place + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                    self.spans.append(("ip", place, end))
                place = end + 1

    def _cards(self, stretch: str, base: int) -> None:
        for run in re.finditer(r"[0-9 -]+", stretch):
            digits = run[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                self.spans.append(("card", base + run.start(), base + run.end()))

    def phone(self, at: int) -> None:
        """From a plus sign and a digit to the last digit of the stretch of digits, blanks, dots, brackets and hyphens."""
        if m := PHONE.match(self.text, at):
            number = m[0].rstrip(" ().-")
            if len(number) >= 4 and 9 <= sum(map(str.isdigit, number)) <= 15:
                self.spans.append(("phone", at, at + len(number)))

    def hidden_email(self, start: int, end: int) -> None:
        """``name [at] host [dot] tld``, with brackets of either kind and a written or a real dot."""
        before = self.text[max(0, start - 65) : start].rstrip(" ")
        name = before[len(before.rstrip(LOCAL)) :]
        host = re.compile(r" ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]{1,63}){1,8}", re.I).match(self.text, end)
        if 0 < len(name) <= 64 and host:
            self.spans.append(("hidden_email", max(0, start - 65) + len(before) - len(name), host.end()))

    def cue(self, kind: str, start: int, end: int) -> None:
        if _wordlike(self.text, start - 1) or _wordlike(self.text, end):
            return
        m = {"iban": IBAN, "account": ACCOUNT, "ssn": SSN}[kind].match(self.text, end)
        if not m:
            return
        value = m[1]
        if kind == "iban" and not _iban_valid(value.replace(" ", "")):
            return
        if kind == "ssn" and (value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000"):
            return
        self.spans.append((kind, *m.span(1)))

    def scheme(self, end: int) -> None:
        """User name and password in front of a host."""
        if m := LOGIN.match(self.text, end):
            self.spans.append(("login", end, m.end() - 1))

    def colons_at(self, at: int) -> None:
        """Eight groups of hexadecimal digits, or fewer around one double colon."""
        if at < self.colons:
            return
        low = max(self.colons, at - 40)
        start = low + len(self.text[low:at].rstrip(HEX))
        end = at
        while end < len(self.text) and self.text[end] in HEX:
            end += 1
        self.colons = end
        if self.text[end - 1] == ":" and self.text[end - 2 : end] != "::":
            end -= 1
        groups = self.text[start:end].split(":")
        full = [g for g in groups if g]
        short = self.text[start:end].count("::") == 1 and ":::" not in self.text[start:end]
        fits = len(full) == 8 == len(groups) or short and 2 <= len(full) <= 7
        if fits and all(len(g) <= 4 for g in full) and not _wordlike(self.text, start - 1) and not _wordlike(self.text, end):
            self.spans.append(("ipv6", start, end))


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, tuple[str, int]] = {"@": ("@", 1), "+": ("+", 1), "://": ("://", 3), ":": (":", 1)}
    found |= {d: ("digit", 1) for d in "0123456789"}
    found |= {f"{a}{x}{b}": ("hidden", 4) for a, b in ("[]", "()") for x in ("at", "AT")}
    for kind, cues in CUES.items():
        found |= {x: (kind, len(x)) for cue in cues for x in (cue, cue.upper(), cue.capitalize())}
    out = ahocorasick.Automaton()
    for anchor, value in found.items():
        out.add_word(anchor, value)
    out.make_automaton()
    return out


def personal_spans(text: str | None) -> list[Span]:
    """``kind, start, end`` of all personal data of a whole text, by kind as in ``KINDS``, then by place; code points, end exclusive."""
    if not text:
        return []
    reader = _Reader(text)
    for last, (anchor, size) in _automaton().iter(text):
        start, end = last - size + 1, last + 1
        if anchor == "digit":
            reader.number(start)
        elif anchor == "@":
            reader.email(start)
        elif anchor == "+":
            reader.phone(start)
        elif anchor == "://":
            reader.scheme(end)
        elif anchor == ":":
            reader.colons_at(start)
        elif anchor == "hidden":
            reader.hidden_email(start, end)
        else:
            reader.cue(anchor, start, end)
    return sorted(set(reader.spans), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; where spans overlap, what they cover together becomes that of the first."""
    cover: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if cover and start < cover[-1][2]:
            cover[-1][2] = max(cover[-1][2], end)
        else:
            cover.append([kind, start, end])
    ends = [0, *(c[2] for c in cover)]
    kept = [text[a : c[1]] for a, c in zip(ends, cover, strict=False)]
    return "".join(f"{part}[{c[0]}]" for part, c in zip(kept, cover, strict=True)) + text[ends[-1] :]


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_personal_data(docs: DataFrame, text_col: str = "text", mask: bool = False) -> DataFrame:
    """Add ``personal``, the spans of a whole text as ``kind, start, end``; with ``mask`` the text has each replaced by its kind.

    A null or empty text has no spans and stays as it is. Rows are taken one by one, so repeated rows give equal
    results, an empty table gives an empty one, and the memory of a long text is its own. Offsets are code points, end exclusive. Without ``mask`` the text is left
    out; an input column named ``personal`` is replaced, others are kept.
    """
    fields = [f for f in docs.schema if f.name != "personal" and (mask or f.name != text_col)]
    schema = T.StructType([*fields, T.StructField("personal", SPAN)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            found = [personal_spans(t) for t in texts]
            add = {"personal": pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], arrow)}
            if mask:
                add[text_col] = pa.array([t and masked(t, s) for t, s in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([add[c] if c in add else batch.column(c) for c in schema.names], schema.names)

    return docs.mapInArrow(run, schema)


def count_of(kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter("personal", lambda s: s["kind"] == kind)).cast("long")


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_spans() -> Column:
    return F.filter("personal", lambda s: s["kind"].isin(*BASE))
