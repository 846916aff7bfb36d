"""Personal data by anchor expansion.

An Aho-Corasick automaton walks a whole text once and stops at anchors: at-signs, plus signs, digits,
schemes and identifier cues. At each anchor a local parser with fixed rules expands the span to its
boundaries and checks it; a parser never goes back before the end of its kind's last match, so a
text of any length is read a bounded number of times.

Kinds and their anchors. Base kinds, each leftmost and non-overlapping:

* ``email``: an at-sign; local part to the left, labels with dots to the right.
* ``ip``: a digit; four numbers with dots, each at most 255.
* ``card``: a digit; digits with single spaces or hyphens, 12 to 19 of them, Luhn checksum.
* ``phone``: a plus sign; 9 to 15 digits among spaces, brackets, dots and hyphens.

Added kinds, which never take anything from the base kinds:

* ``address``: a scheme; a web address that names a user before its host, with any path after it.
* ``account``: an identifier cue; an IBAN with checksum, a social security number after its cue
  (no group of zeros), or a number of 6 to 17 digits after an account cue.

Defined cases: a null text counts as empty and has no spans; null and repeated ids are rows like any
other; overlapping spans of different kinds are all reported; other columns stay as they are in
``redact`` and are not read elsewhere; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from larkseek.llm.common import free_name, output_batch, slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "smb://")
IBAN_CUES = ("IBAN",)
SOCIAL_CUES = ("SSN", "social security number", "Social Security Number")
ACCOUNT_CUES = ("account number", "Account number", "Account Number", "account no", "Account no", "Account No", "acct", "Acct", "Kontonummer", "numéro de compte", "número de cuenta")

Found = tuple[int, int] | None

_LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBER = re.compile(r"[0-9]+")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AFTER_CUE = re.compile(r"(?:[ .:#=]|is\b){0,6}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SOCIAL = re.compile(r"(?!000|666|9)[0-9]{3}([ -]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
_USER_URL = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=:-]+@[A-Za-z0-9.-]*[A-Za-z0-9](?::[0-9]+)?(?:[/?#][^\s<>\"]*)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _email(text: str, at: int, free: int) -> tuple[Found, int]:
    """The email around the at-sign, and where the next one may begin."""
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    m = _LABELS.match(text, at + 1) if start < at else None
    return ((start, m.end()), m.end()) if m else (None, free)


def _ip(text: str, at: int) -> tuple[Found, int]:
    m = _QUAD.match(text, at)
    if not m:
        return None, _NUMBER.match(text, at).end()  # no later start in this number can do better
    small = all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))
    return ((at, m.end()) if small else None), m.end()


def _card(text: str, at: int) -> tuple[Found, int]:
    m = _CHAIN.match(text, at)
    if not m:
        return None, at + 1
    digits = m[0].replace(" ", "").replace("-", "")
    return ((at, m.end()) if 12 <= len(digits) <= 19 and luhn(digits) else None), m.end()


def _phone(text: str, at: int) -> tuple[Found, int]:
    m = _PHONE.match(text, at)
    if not m:
        return None, at + 1
    return ((at, m.end()) if 9 <= sum(c.isdigit() for c in m[0]) <= 15 else None), m.end()


def _address(text: str, scheme: int, after: int) -> tuple[Found, int]:
    m = _USER_URL.match(text, after)
    return ((scheme, m.end()), m.end()) if m else (None, after)


def _iban(text: str, after: int) -> tuple[Found, int]:
    """The longest run that passes the checksum: a word in capitals may follow the number."""
    at = _AFTER_CUE.match(text, after).end()
    m = _IBAN.match(text, at)
    for end in range(m.end(), at + 14, -1) if m else ():
        if text[end - 1] != " " and not text[end:end + 1].isalnum():
            flat = text[at:end].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1:
                return (at, end), end
    return None, after


def _after_cue(pattern: re.Pattern[str]) -> Callable[[str, int], tuple[Found, int]]:
    def parse(text: str, after: int) -> tuple[Found, int]:
        m = pattern.match(text, _AFTER_CUE.match(text, after).end())
        return (m.span(), m.end()) if m else (None, after)
    return parse


class Finder:
    """The automaton and one pass over a text."""

    def __init__(self) -> None:
        self.anchors = ahocorasick.Automaton()
        cues = ([(s, "address", None) for s in SCHEMES] + [(c, "account", _iban) for c in IBAN_CUES] + [(c, "account", _after_cue(_SOCIAL)) for c in SOCIAL_CUES]
                + [(c, "account", _after_cue(_ACCOUNT)) for c in ACCOUNT_CUES])
        for word, kind, parse in [("@", "email", None), ("+", "phone", None), *((d, "digit", None) for d in "0123456789"), *cues]:
            self.anchors.add_word(word, (len(word), kind, parse))
        self.anchors.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end), ordered; places are code points."""
        out: list[tuple[int, int, int]] = []
        free = dict.fromkeys(KINDS, 0)

        def note(kind: str, answer: tuple[Found, int]) -> None:
            found, free[kind] = answer
            if found:
                out.append((found[0], KINDS.index(kind), found[1]))

        for last, (n, kind, parse) in self.anchors.iter(text):
            at = last + 1 - n
            if kind == "digit":
                if at >= free["ip"]:
                    note("ip", _ip(text, at))
                if at >= free["card"]:
                    note("card", _card(text, at))
            elif at < free[kind]:
                continue
            elif kind == "email":
                note("email", _email(text, at, free["email"]))
            elif kind == "phone":
                note("phone", _phone(text, at))
            elif kind == "address":
                note("address", _address(text, at, last + 1))
            else:
                note("account", parse(text, last + 1))
        return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, all spans, for every row."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            for rows in slices(batch):
                spans = [finder.spans(t) if t else [] for t in rows.column(1).to_pylist()]
                base = [[s for s in each if s[1] < len(BASE_KINDS)] for each in spans]
                yield output_batch(schema, [rows.column(0), *([sum(s[1] == k for s in each) for each in base] for k in range(len(BASE_KINDS))),
                                            [hashlib.sha256(written(each).encode()).hexdigest() for each in base], [written(each) for each in spans]])

    return docs.selectExpr(f"cast(`{doc_id}` as bigint) as doc_id", f"cast(`{text}` as string) as text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of a text replaced by its kind in square brackets; overlapping spans
    become one, named by the first. Null texts stay null."""
    out = free_name(docs, "redacted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            for rows in slices(batch):
                texts = []
                for t in rows.column(text).to_pylist():
                    parts, at = [], 0
                    for a, k, b in finder.spans(t) if t else []:
                        if a >= at:
                            parts += [t[at:a], f"[{KINDS[k]}]"]
                        at = max(at, b)
                    texts.append("".join([*parts, t[at:]]) if t is not None else None)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, out])

    from pyspark.sql import types as T
    whole = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))
    return whole.select(*[whole[out].alias(c) if c == text else whole[c] for c in docs.columns])
