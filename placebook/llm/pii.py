"""Personal data: patterns propose spans, checksums confirm them, context words move the score."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches

#: Kinds of spans in the order that breaks ties of the start.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "key", "secret")
BASE_KINDS = KINDS[:4]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: from inside a run it would fail as
# from its beginning. The look-behind keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# Keys whose form tells what they are; each pattern is looked for only where its first characters stand.
KEYS = {
    "AKIA": re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "ASIA": re.compile(r"(?<![A-Za-z0-9])ASIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    **{f"gh{kind}_": re.compile(rf"(?<![A-Za-z0-9])gh{kind}_[A-Za-z0-9]{{36}}(?![A-Za-z0-9])") for kind in "opsu"},
    "-----BEGIN ": re.compile(r"-----BEGIN (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----"),
}
# A name for a secret up to the sign that gives it a value, and the value.
SECRET_NAME = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\x20\t]{0,3}$", re.IGNORECASE)
SECRET_VALUE = re.compile(r"[\x20\t]{0,3}(?:\"([^\"\s]{8,512})\"|'([^'\s]{8,512})'|([^\s\"',;]{8,512}))")
NAME_ROOM = 16
#: Bits that a character of a secret has at least, by the frequencies of the value's characters; prose has no digits besides.
SECRET_BITS = 2.0

#: The length of an IBAN by country; other countries' may have any from 15 to 34.
_LENGTHS = """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18
FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22
MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23
TN24 TR26 UA29 VA22 VG24 XK20 YE30"""
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in _LENGTHS.split()}

#: Words that make a kind likelier when they stand within CONTEXT characters before or after it.
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "key": ("key", "access", "credentials", "secret"),
    "secret": ("login", "user", "username", "credentials", "bearer", "authorization"),
}
CONTEXT = 48
#: A proposal's score before context, what each context word adds at first, and what is needed.
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "key": 0.9, "secret": 0.7}
CONTEXT_GAIN = 0.3
NEEDED = 0.5
_WORDS = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v)) + r")\b", re.IGNORECASE) for k, v in CONTEXT_WORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an IBAN: country and check digits moved to the end, letters as 10-35."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ outwards: linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", end if found else at + 1)
    return out


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def is_card(s: str) -> bool:
    digits = only_digits(s)
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_phone(s: str) -> bool:
    return 10 <= sum("0" <= c <= "9" for c in s) <= 15


def iban_end(text: str, start: int, stop: int) -> int | None:
    """Where the IBAN ends that begins at start: with its country's length, or at the last group border that mod-97 confirms."""
    only, ends, n = IBAN_LENGTHS.get(text[start : start + 2]), [], 0
    for at in range(start, stop):
        if text[at] != " ":
            n += 1
            border = at + 1 == len(text) or not (text[at + 1].isascii() and text[at + 1].isalnum())
            if border and (n == only if only else 15 <= n <= 34):
                ends.append(at + 1)
    return next((end for end in reversed(ends) if mod97(text[start:end].replace(" ", ""))), None)


def ibans(text: str) -> list[tuple[int, int]]:
    """Leftmost IBANs; what follows one, or a group that begins none, is searched again."""
    out, m = [], IBAN.search(text)
    while m:
        end = iban_end(text, m.start(), m.end())
        if end:
            out.append((m.start(), end))
        m = IBAN.search(text, end or m.start() + 4)
    return out


def is_ssn(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"


def is_secret(value: str) -> bool:
    """Letters and digits, and characters that vary: no word of prose."""
    if not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= SECRET_BITS


def secrets(text: str) -> list[tuple[int, int]]:
    """The values, without their quotes, that names for secrets are given, found from each = and : outwards."""
    out, end = [], 0
    for sign in re.finditer("[=:]", text) if "=" in text or ":" in text else ():
        at = sign.start()
        if at >= end and SECRET_NAME.search(text[max(end, at - NAME_ROOM) : at]) and (m := SECRET_VALUE.match(text, at + 1)):
            start, stop = m.span(m.lastindex)
            if is_secret(text[start:stop]):
                out.append((start, stop))
                end = m.end()
    return out


def access_keys(text: str) -> list[tuple[int, int]]:
    return sorted(m.span() for first, pattern in KEYS.items() if first in text for m in pattern.finditer(text))


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, higher where one of its context words stands shortly before or after the span."""
    near = _WORDS[kind].search(text, max(0, start - CONTEXT), start)
    if not near:
        # one character more, so that no word is cut into a context word
        near = _WORDS[kind].search(text, end, end + CONTEXT + 1)
        near = near and near.end() <= end + CONTEXT
    return min(1.0, PRIOR[kind] + (CONTEXT_GAIN if near else 0.0))


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, ordered by start and then kind.

    Per kind, matches are leftmost and do not overlap; those that fail their check are
    dropped without a retry, but for ibans, which may run into upper-case words and numbers. The checks confirm email, ip, card and phone by themselves
    (their score is only reported); iban needs mod-97, ssn a context word besides its form,
    secret a name before it and a value that is no word; a key's form is enough.
    """
    found = [("email", *x) for x in emails(text)] + [("iban", *x) for x in ibans(text)] + [("secret", *x) for x in secrets(text)]
    found += [("key", *x) for x in access_keys(text)]
    for kind, pattern, check in (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone), ("ssn", SSN, is_ssn)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if check(m[0])]
    scored = [(k, s, e, score(text, k, s, e)) for k, s, e in found]
    return sorted((x for x in scored if x[3] >= NEEDED), key=lambda x: (x[1], KINDS.index(x[0])))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def detect_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): a row for each input row, whole texts; null and empty texts have no spans.

    Repeated rows are searched each on its own; other columns are ignored; an empty table
    gives no rows. Rows don't meet, so there is no shuffle, and time and memory are linear in a text's length.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def make():
        def apply(batch):
            texts = batch.column("text").to_pylist()
            return {"id": batch.column("id"), "spans": [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in find_spans(t)] if t else [] for t in texts]}

        return apply

    return map_batches(rows, f"id {kind}, spans {SPANS}", make).withColumnRenamed("id", id_col)


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])
