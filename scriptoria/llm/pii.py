"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Defined results: a null text is the empty text and has no spans; a null id is kept;
repeated rows give repeated results; an empty table gives no rows; other columns stay
as they are, and a column already called like the output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.common import whole_text

#: Kinds the contract names, in its order, then those this operator adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

# A maximal run of digits, local characters or letters is entered at its start only: a
# later start in the same run fails where the first one fails, so nothing is lost, and a
# long run is not tried from each of its characters.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# A capital before a small letter begins another word.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9](?![a-z])){11,30}+(?![A-Za-z0-9])")

#: Words that make a kind likelier when they stand near a span.
CONTEXT = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer", "konto"),
}
#: Score of a confirmed span without context; what one context word adds.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.6, "phone": 0.6, "iban": 0.8}
CONTEXT_BONUS = 0.2
CONTEXT_CHARS = 48
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """The mod-10 checksum of card numbers."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 7064 checksum of account numbers, without blanks."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of every kind that pass their validator."""
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", *m.span()
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            yield "iban", *m.span()


def spans(text: str) -> list[dict]:
    """All spans by start, then kind, each with its score; offsets count code points."""
    found = sorted(proposals(text), key=lambda s: (s[1], KINDS.index(s[0])))
    out = []
    for kind, start, end in found:
        near = (text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]).lower()
        hits = sum(word in near for word in CONTEXT[kind])
        out.append({"kind": kind, "start": start, "end": end, "score": min(1.0, PRIOR[kind] + CONTEXT_BONUS * hits)})
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


@F.arrow_udf(T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("score", "double")))
def pii_spans(texts: pa.Array) -> pa.Array:
    return pa.array([spans(t.as_py()) for t in texts], pa.list_(SPAN))


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """*docs* with the array of spans of its text in column *out*."""
    return docs.withColumn(out, pii_spans(whole_text(text)))
