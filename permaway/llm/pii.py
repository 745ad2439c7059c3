"""Personal data: patterns propose spans, checksums confirm them, context words move their score.

Base kinds (a proposal that fails its check is dropped, with no retry):

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+){3}``, each part at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 14 to 19 digits, Luhn
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 10 to 15 digits

The method adds, outside the base spans: iban (country's letters and digits,
15 to 34 characters, mod 97 = 1), ssn (NNN-NN-NNNN with issued ranges), national
phone numbers without ``+``, and secrets (access keys, assigned passwords and tokens).  A proposal starts from the score of its kind; a
confirmed checksum raises it, words of ``CONTEXT`` within 40 characters before it
raise it, words of ``AGAINST`` lower it.  Added spans need a score of ``LEAST``.

Positions are code points, ends exclusive.  Defined cases: null or empty text has
no spans; spans may touch; a text of digits only is scanned in linear time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permaway.llm.storage import arrow_batches
from permaway.llm.workers import serving

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone", "secret")
BASE = KINDS[:4]
#: Score of a proposal before checks and context.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.7, "iban": 0.4, "ssn": 0.4, "local_phone": 0.4, "secret": 0.7}
CONFIRMED, NEAR, AWAY, LEAST = 0.4, 0.3, -0.3, 0.6
CONTEXT = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social security", "tax id"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
    "secret": ("key", "login", "credential"),
}
AGAINST = ("version", "isbn", "order no", "part no", "serial", "chapter")
REACH = 40

_LOCAL_PART = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:password|passwd|token|secret|api_?key) ?[=:] ?(?:\"[^\"\s]{8,}\"|[^\"\s]{8,})")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches: the local part is all that stands before the sign, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_PART:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
            done = end
        at = text.find("@", end)


def _base(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return found


def _score(kind: str, text: str, start: int, confirmed: bool) -> float:
    before = text[max(0, start - REACH) : start].lower()
    score = PRIOR[kind] + CONFIRMED * confirmed
    score += NEAR * any(w in before for w in CONTEXT[kind]) + AWAY * any(w in before for w in AGAINST)
    return min(1.0, max(0.0, score))


def _numbers(text: str) -> Iterator[tuple[str, int, int, bool]]:
    for m in _IBAN.finditer(text):
        # a following word in capitals may hang on: the longest prefix of whole groups that passes counts
        parts, end = m[0].split(" "), m.end()
        while len("".join(parts)) >= 15:
            if mod97("".join(parts)):
                yield "iban", m.start(), end, True
                break
            end -= len(parts.pop()) + 1
    for m in _SSN.finditer(text):
        a, b, c = m.groups()
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            yield "ssn", *m.span(), False
    for m in _LOCAL_PHONE.finditer(text):
        yield "local_phone", *m.span(), False


def _more(text: str) -> Iterator[tuple[str, int, int, bool]]:
    if _DIGIT.search(text):
        yield from _numbers(text)
    if "=" in text or ":" in text or "AKIA" in text:  # one of these stands in every secret
        for m in _SECRET.finditer(text):
            yield "secret", *m.span(), False


def spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """All spans by start, then kind: (start, end, kind, score)."""
    if not text:
        return []
    base = _base(text)
    found = [(a, b, kind, _score(kind, text, a, kind in ("card", "ip"))) for kind, a, b in base]
    base.sort(key=lambda x: x[1])
    starts, reach = [x for _, x, _ in base], list(accumulate((y for *_, y in base), max))
    for kind, a, b, confirmed in _more(text):
        before = bisect_left(starts, b)  # base spans that begin before its end: one overlaps if their furthest end does
        if not (before and reach[before - 1] > a) and (s := _score(kind, text, a, confirmed)) >= LEAST:
            found.append((a, b, kind, s))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


SPAN = "array<struct<first:int,last:int,kind:string,score:double>>"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and its spans (first, last exclusive, kind, score)."""
    arrow_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"first": a, "last": b, "kind": k, "score": s} for a, b, k, s in spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(serving("personal data", run), f"doc_id long, spans {SPAN}")


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    for a, b, kind, _ in found:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked; ``n_chars``, where there is one, follows the new text."""
    arrow_batches(docs.sparkSession)
    number = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(number).to_pylist()
            new = [masked(t) for t in old]
            if new != old:
                batch = batch.set_column(number, batch.schema.field(number), pa.array(new, batch.schema.field(number).type))
                if count is not None:
                    n = [b if x is y else len(x) for x, y, b in zip(new, old, batch.column(count).to_pylist(), strict=True)]
                    batch = batch.set_column(count, batch.schema.field(count), pa.array(n).cast(batch.schema.field(count).type))
            yield batch

    return docs.mapInArrow(serving("personal data", run), docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from the operator's spans."""
    text = lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_personal_data(docs).select(
        "doc_id", *map(count, BASE), F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans")
    )


def brute_force(doc_id: int, text: str | None) -> tuple:
    """The base columns by the contract's own patterns, with no shortcuts; for tests."""
    text = text or ""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(_digits(m[0])) <= 15]
    found.sort(key=lambda x: (x[1], BASE.index(x[0])))
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (doc_id, *(sum(k == x[0] for x in found) for k in BASE), hashlib.sha256(joined.encode()).hexdigest())
