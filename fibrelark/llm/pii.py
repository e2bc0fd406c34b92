"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the whole text: at-signs,
plus signs, digits, URL schemes and identifier cues. At each anchor a small local
parser expands to the left and right and validates the boundary (labels of a host,
parts of an address, check digits, digit counts). The four base kinds come out just
as a leftmost scan without overlaps would find them; ``url``, ``secret`` and
``account`` are further kinds, and a ``card`` is also found where it stands
beside other digits in a run that fails as a whole.

Defined results: null text counts as empty and has no spans; very long texts are
scanned whole; doc_id may be null or repeat, each row stands for itself; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fibrelark.llm.common import batches, text_column

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "secret", "account")
RANK = {kind: k for k, kind in enumerate(KINDS)}

# Cues before a secret or an account number.
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key")
BEARER_CUES = ("bearer",)
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport")

_DIGITS = frozenset("0123456789")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
_URL = re.compile(r"[A-Za-z0-9][^\s<>\"'|\\^`{}]*")
# Any number of blanks; what follows a cue can always match, so no blanks are read twice.
_SECRET = re.compile(r"[\"']?[ \t]*(?:=>|:=|=|:)[ \t]*[\"']?([A-Za-z0-9+/_.-]{8,})")
_BEARER = re.compile(r"[ \t]+[\"']?([A-Za-z0-9+/_.~-]{16,})")
_ACCOUNT = re.compile(r"[ \t]*(?:numbers?\b|no\b\.?|nr\b\.?|#)?[ \t]*(?:is\b|=>|:=|=|:)?[ \t]*")
_ACCOUNT_START = re.compile(r"[A-Z]{0,2}[0-9]")
# No account is longer than an IBAN, so a group is read up to one character more.
ACCOUNT_LENGTH = 34
_GROUP = re.compile(r"[ -]*([0-9A-Z]{1,%d})" % (ACCOUNT_LENGTH + 1))
_TRAILING = ".,;:!?)]}*$%&#"


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for digit in _DIGITS:
        found.add_word(digit, ("digit", 1))
    for scheme in ("http://", "https://", "ftp://"):
        found.add_word(scheme, ("scheme", len(scheme)))
    for cues, kind in ((SECRET_CUES, "secret"), (BEARER_CUES, "bearer"), (ACCOUNT_CUES, "account")):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


_AUTOMATON: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    """One automaton for each worker process."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _automaton()
    return _AUTOMATON


def _lowered(text: str) -> str:
    """The text in lower case, each character at its place, so that anchors are found in any spelling."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if k % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _ip_holds(match: str) -> bool:
    return all(len(part) <= 3 and int(part) <= 255 for part in (p.lstrip("0") or "0" for p in match.split(".")))


def _iban_holds(value: str) -> bool:
    if not 15 <= len(value) <= 34 or not value[:2].isalpha() or not value.isalnum():
        return False
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The account number whose groups begin here, the longest that holds: an IBAN, or 8 digits or more."""
    if not _ACCOUNT_START.match(text, at):
        return None
    end, value, place = 0, "", at
    while (group := _GROUP.match(text, place)) and len(value) + len(group[1]) <= ACCOUNT_LENGTH:
        value += group[1]
        place = group.end()
        if _iban_holds(value) or (value.isdigit() and len(value) >= 8):
            end = place
    return (at, end) if end else None


def _cards_within(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Parts of a run from one group of digits to another that have a card's number of digits and check digit."""
    groups = [(m.start(), m.end()) for m in _RUN.finditer(text, start, end)]
    out = []
    for k, (first, _) in enumerate(groups):
        digits = ""
        for low, high in groups[k : k + 19]:
            if len(digits) + high - low > 19:
                break
            digits += text[low:high]
            if len(digits) >= 14 and luhn(digits):
                out.append((first, high))
    return out


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and further spans of the method; (kind, start, end), each in page order."""
    base: list[tuple[str, int, int]] = []
    more: list[tuple[str, int, int]] = []
    ends = {"email": 0, "ip": 0, "card": 0, "phone": 0, "url": 0}
    for last, (anchor, length) in automaton().iter(_lowered(text)):
        at = last - length + 1
        if anchor == "digit":
            if at >= ends["ip"] and (at == 0 or text[at - 1] not in _DIGITS) and (m := _IP.match(text, at)):
                ends["ip"] = m.end()
                if _ip_holds(m[0]):
                    base.append(("ip", at, m.end()))
            if at >= ends["card"] and (m := _CARD.match(text, at)):
                ends["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    base.append(("card", at, m.end()))
                elif len(digits) > 14:
                    # The run as a whole fails: a card may stand beside other numbers in it.
                    more += [("card", *span) for span in _cards_within(text, at, m.end())]
        elif anchor == "at":
            if at >= ends["email"] and (m := _HOST.match(text, at + 1)):
                start = at
                while start > ends["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at:
                    ends["email"] = m.end()
                    base.append(("email", start, m.end()))
        elif anchor == "plus":
            if at >= ends["phone"] and (m := _PHONE.match(text, at)):
                ends["phone"] = m.end()
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    base.append(("phone", at, m.end()))
        elif anchor == "scheme":
            if at >= ends["url"] and (m := _URL.match(text, last + 1)):
                end = m.end()
                while end > last + 1 and text[end - 1] in _TRAILING:
                    end -= 1
                if end > last + 1:
                    ends["url"] = m.end()
                    more.append(("url", at, end))
        elif anchor in ("secret", "bearer"):
            found = (_SECRET if anchor == "secret" else _BEARER).match(text, last + 1)
            # A short number behind a cue is no secret.
            if found and any(c in _DIGITS for c in found[1]) and (len(found[1]) >= 16 or not found[1].isdigit()):
                more.append(("secret", found.start(1), found.end(1)))
        elif (at == 0 or not text[at - 1].isalpha()) and (span := _account(text, _ACCOUNT.match(text, last + 1).end())):
            more.append(("account", *span))
    order = lambda s: (s[1], RANK[s[0]], s[2])
    base.sort(key=order)
    taken = set(base)
    return base, sorted(set(more) - taken, key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=lambda s: (s[1], RANK[s[0]], s[2])))


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(parts):
        rows: dict[str, list] = {f"n_{kind}": [] for kind in BASE_KINDS} | {"base_sha256": [], "spans": [], "n_spans": []}
        for text in text_column(batch, "text"):
            base, more = find_spans(text)
            for kind in BASE_KINDS:
                rows[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            rows["spans"].append(joined(base + more))
            rows["n_spans"].append(len(base) + len(more))
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), *(pa.array(rows[k], pa.int64() if k.startswith("n_") else pa.string()) for k in rows)],
            names=["doc_id", *rows],
        )


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans for every row; reads doc_id and text only, no exchange."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, schema)


def redact_text(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans merge."""
    base, more = find_spans(text)
    out, end = [], 0
    for kind, start, stop in sorted(base + more, key=lambda s: (s[1], -s[2], RANK[s[0]])):
        if start >= end:
            out += [text[end:start], f"<{kind.upper()}>"]
        end = max(end, stop)
    return "".join(out) + text[end:] if out else text


def _redact(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(parts):
        k = batch.schema.get_field_index("text")
        texts = [None if t is None else redact_text(t) for t in batch.column(k).to_pylist()]
        batch = batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
        if (n := batch.schema.get_field_index("n_chars")) >= 0:
            field = batch.schema.field(n)
            batch = batch.set_column(n, field, pa.array([None if t is None else len(t) for t in texts], field.type))
        yield batch


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, with personal data in ``text`` replaced; a column n_chars follows."""
    return docs.mapInArrow(_redact, docs.schema)
