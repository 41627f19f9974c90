"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Each kind of span has a pattern, a validator that a proposal must pass and a prior. Words
of the kind near the span raise its score, words that name other numbers lower it; a span is
reported when its score reaches the threshold. The base kinds need no context: their prior
is the threshold and words near them change their score only above it. All patterns take
time linear in the text. Texts are searched where they are read; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quaymaster.llm.common import blocks, struct

BLOCK_BYTES = 4 << 20
THRESHOLD = 0.5
NEAR = 48  # characters before a span, and half as many after, in which context words count
STEP = 0.2  # what one kind of context adds or takes
SPAN_LIST = "array<struct<kind:string,start:int,end:int,score:double>>"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Runs of digits are taken whole, so a start within a run is never tried and nothing is tried twice.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])")
SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
DIGIT = re.compile("[0-9]")

# --- fixed values: lengths of international bank account numbers by country ---
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20,
}


@dataclass(frozen=True)
class Kind:
    """``find`` yields (start, end) of proposals, leftmost first and apart; ``valid`` confirms the matched text."""
    name: str
    find: Callable[[str], Iterator[tuple[int, int]]]
    valid: Callable[[str], bool]
    prior: float
    near: re.Pattern | None = None
    against: re.Pattern | None = None
    base: bool = False


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def luhn(digits: str) -> bool:
    """The checksum of payment cards: every second digit from the right doubled, digits of products added."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod_97(account: str) -> bool:
    """The checksum of bank account numbers: country and check digits last, letters as 10 to 35, remainder 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, leftmost first. Found from their ``@``, as runs without one would be tried from each character."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = done + len(text[done:at].rstrip(LOCAL)) if domain else at
        if start < at:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def _matches(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Proposals cut to the length of their country; words that follow in capitals are no part of it."""
    for m in IBAN.finditer(text):
        length = IBAN_LENGTHS.get(m.group()[:2])
        places = [i for i, c in enumerate(m.group(), m.start()) if c != " "]
        if length and len(places) >= length:
            end = places[length - 1] + 1
            if end == m.end() or text[end] == " ":
                yield m.start(), end


def _card(text: str) -> bool:
    digits = digits_of(text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _social(text: str) -> bool:
    """Area, group and serial that are given out."""
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


KINDS = (
    Kind("email", emails, lambda s: True, 0.5, re.compile(r"(?i)\b(?:e-?mail|contact|write|address)\b"), None, True),
    Kind("ip", _matches(IP), lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split(".")), 0.5,
         re.compile(r"(?i)\b(?:ip|host|server|client|address)\b"), None, True),
    Kind("card", _matches(CARD), _card, 0.5, re.compile(r"(?i)\b(?:card|visa|mastercard|credit|debit|payment)\b"), None, True),
    Kind("phone", _matches(PHONE), lambda s: 10 <= len(digits_of(s)) <= 15, 0.5, re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax)\b"), None, True),
    Kind("iban", _ibans, lambda s: mod_97(s.replace(" ", "")), 0.6, re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"), None),
    Kind("ssn", _matches(SOCIAL), _social, 0.35, re.compile(r"(?i)\b(?:ssn|social security)\b"),
         re.compile(r"(?i)\b(?:order|invoice|part|serial|case)\b")),
    Kind("local_phone", _matches(LOCAL_PHONE), lambda s: s.count("(") == s.count(")"), 0.35, re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|cell)\b"),
         re.compile(r"(?i)\b(?:order|invoice|part|serial|isbn)\b")),
)
BASE = tuple(k.name for k in KINDS if k.base)


def score(kind: Kind, text: str, start: int, end: int) -> float:
    """The prior, more with a word of the kind nearby, less with a word against it; of base kinds never under the prior."""
    around = text[max(start - NEAR, 0):start] + "\n" + text[end:end + NEAR // 2]
    value = kind.prior
    if kind.near and kind.near.search(around):
        value += STEP
    if kind.against and kind.against.search(around):
        value -= STEP
    return max(value, kind.prior) if kind.base else value


def spans_of(text: str, kinds: tuple[Kind, ...] = KINDS, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed; other kinds give way where a base span lies."""
    if not DIGIT.search(text) and "@" not in text:
        return []
    found = []
    for order, kind in enumerate(kinds):
        for start, end in kind.find(text):
            if kind.valid(text[start:end]):
                value = score(kind, text, start, end)
                if value >= threshold:
                    found.append((start, order, end, kind, value))
    found.sort(key=lambda f: f[:3])
    return [(kind.name, start, end, value) for start, end, kind, value in _apart(found)]


def _apart(found: list[tuple]) -> Iterator[tuple]:
    """All base spans, and the others that overlap none of them."""
    base = [(start, end) for start, _, end, kind, _ in found if kind.base]
    reach, i = -1, 0  # the furthest end of base spans that start before the one in hand ends
    for start, _, end, kind, value in found:
        while i < len(base) and base[i][0] < end:
            reach, i = max(reach, base[i][1]), i + 1
        if kind.base or reach <= start:
            yield start, end, kind, value


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, spans) for every row: spans (kind, start, end, score) in code points, ends exclusive, by start.

    Every whole text is searched. A null or empty text has no spans, nor has one without a digit or ``@``. Rows that repeat are
    judged each; an empty table gives an empty result. Only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for part in blocks(batches, "text", BLOCK_BYTES):
            lists = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t or "", kinds, threshold)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lists, SPANS)], names=["id", "spans"])

    return rows.mapInArrow(run, struct(f"id {rows.schema['id'].dataType.simpleString()}, spans {SPAN_LIST}")).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, text_col) with ``<kind>`` in place of each span; of spans that overlap the first stands for all. Null stays null."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def masked(text: str | None) -> str | None:
        out, upto = [], 0
        for kind, start, end, _ in spans_of(text or "", kinds, threshold):
            if start >= upto:
                out += [text[upto:start], f"<{kind}>"]
            upto = max(upto, end)
        return "".join([*out, text[upto:]]) if out else text

    def run(batches):
        for part in blocks(batches, "text", BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(map(masked, part.column("text").to_pylist()), pa.string())], names=["id", "text"])

    return (rows.mapInArrow(run, struct(f"id {rows.schema['id'].dataType.simpleString()}, text string"))
            .withColumnsRenamed({"id": id_col, "text": text_col}))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
