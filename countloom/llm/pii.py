"""Personal data by anchor expansion.

One Aho-Corasick pass over a text, with A-Z lower-cased, finds anchors: at-signs, plus signs, digits, schemes and identifier cues. A
local parser expands each anchor to its boundaries and validates it; nothing else of the text is looked at, and the end of what a parser has
read is remembered a kind, so that a text is read a bounded number of times however its anchors lie.

Kinds, in the order in which spans of one start are listed:
email, ip, card, phone: the base kinds, leftmost and without overlap inside a kind, as the patterns in BASE say; a match that fails its
validation is dropped and not tried again at another place.
address: what the base kinds can't bound: mail addresses with letters beyond ASCII, and web addresses (scheme://) that carry user
information, from the scheme to the end of the host and port.
account: the identifier behind a cue such as "iban", "account no." or "ssn", validated by its cue: IBANs by remainder 97, social security numbers
by their ranges, tokens and keys by length and by digits beside letters, other numbers by length and count of digits.
Added spans that lie inside a base span are left out; base spans are never changed.

Positions are code points, ends are exclusive.

Nulls and odd rows: null text is empty and has no spans; rows with a null doc_id, and each row of a repeated one, are searched too; an empty table
gives no rows; other columns are ignored. Whole texts are searched. There is no shuffle, so no key can be hot.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*BASE, "address", "account"]
SPANS = "array<struct<kind:string,start:int,stop:int>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
WIDE_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)+")
DIGITS, IP = re.compile(r"[0-9]+"), re.compile(BASE["ip"])
CARD, PHONE = re.compile(BASE["card"]), re.compile(BASE["phone"])
NOT_DIGITS = re.compile(r"[^0-9]+")
#: What may stand between user information and the host of a web address, up to its "@"; then the host.
USER = re.compile(r"[^\s/?#@\"'<>]{1,256}@((?:[\w-]+\.)*[\w-]+|\[[0-9A-Fa-f:.]{2,45}\])(?::[0-9]{1,5})?")

#: Cues, and how the identifier behind them is validated.
CUES = {
    "iban": "iban",
    "ssn": "ssn", "social security": "ssn",
    "token": "secret", "api key": "secret", "api_key": "secret", "apikey": "secret", "secret": "secret",
    "account": "number", "acct": "number", "passport": "number", "customer id": "number", "user id": "number", "tax id": "number", "konto": "number", "cuenta": "number", "compte": "number",
}
#: Between cue and identifier: "no", "number" or "key" once, then at most eight of space, colon, equals, hash and quote.
GAP = re.compile(r"(?:[ _-]?(?:no\.?|nr\.?|number|key|id)(?![A-Za-z0-9]))?[ \t:=#\"']{1,8}", re.A)
IDENTIFIER = {
    "iban": re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}"),
    "ssn": re.compile(r"[0-9]{3}([ -]?)[0-9]{2}\1[0-9]{4}(?![A-Za-z0-9])"),
    "secret": re.compile(r"[A-Za-z0-9_+/=-]{16,512}(?![A-Za-z0-9])"),
    "number": re.compile(r"[A-Za-z]{0,4}[0-9](?:[ -]?[0-9]){4,23}(?![A-Za-z0-9])"),
}


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the check of card numbers."""
    twice = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(t - 9 * (t > 9) for t in twice)) % 10 == 0


def iban(text: str, start: int, stop: int) -> int:
    """The end of the longest valid IBAN that starts at start and ends by stop, at the end of a group; 0 if there is none."""
    while stop > start:
        code = text[start:stop].replace(" ", "").upper()
        if len(code) < 15:
            return 0
        if not text[stop : stop + 1].isalnum() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return stop
        stop = text.rfind(" ", start, stop)
    return 0


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ["@", "+", "://", *"0123456789", *CUES]:
        found.add_word(word, word)
    found.make_automaton()
    return found


class Parsers:
    """The local parsers of one text. Each has read up to its own place, and starts no match before it."""

    def __init__(self, text: str):
        self.text, self.spans = text, []
        self.read = dict.fromkeys(KINDS, 0)

    def add(self, kind: str, start: int, stop: int, valid: bool = True) -> None:
        self.read[kind] = stop
        if valid:
            self.spans.append((start, KINDS.index(kind), stop))

    def at_sign(self, at: int) -> None:
        text, start = self.text, at
        while start > self.read["email"] and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            self.add("email", start, host.end())
        wide = WIDE_HOST.match(text, at + 1)
        if wide:
            left = at
            while left > self.read["address"] and (text[left - 1] in LOCAL or text[left - 1].isalnum()):
                left -= 1
            while left < at and text[left] in ".%+-":
                left += 1
            stop = wide.end()
            while stop > at and text[stop - 1] in "-_":
                stop -= 1
            wider = not host or left < start or stop > host.end()
            self.add("address", left, stop, left < at and wider and not text[left:stop].isascii())

    def plus(self, at: int) -> None:
        found = PHONE.match(self.text, at)
        if found:
            self.add("phone", at, found.end(), 10 <= len(NOT_DIGITS.sub("", found.group())) <= 15)

    def digit(self, at: int) -> None:
        if at >= self.read["ip"]:
            found = IP.match(self.text, at)
            if found:
                self.add("ip", at, found.end(), all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in found.group().split(".")))
            else:
                self.read["ip"] = DIGITS.match(self.text, at).end()
        if at >= self.read["card"]:
            found = CARD.match(self.text, at)
            if found:
                digits = found.end() - at > 13 and NOT_DIGITS.sub("", found.group())
                self.add("card", at, found.end(), bool(digits) and 14 <= len(digits) <= 19 and luhn(digits))

    def scheme(self, at: int) -> None:
        text, start = self.text, at
        while start > max(self.read["address"], at - 32) and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
            start -= 1
        user = USER.match(text, at + 3)
        if start < at and user:
            self.add("address", start, user.end())

    def cue(self, at: int, word: str) -> None:
        text, stop, kind = self.text, at + len(word), CUES[word]
        if at < self.read["account"] or text[at - 1 : at].isalnum():
            return
        gap = GAP.match(text, stop)
        found = gap and IDENTIFIER[kind].match(text, gap.end())
        if not found:
            return
        start, stop, got = found.start(), found.end(), found.group()
        if kind == "iban":
            stop = iban(text, start, stop)
            valid = stop > 0
        elif kind == "ssn":
            d = NOT_DIGITS.sub("", got)
            valid = d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        elif kind == "secret":
            valid = any(c.isdigit() for c in got) and any(c.isalpha() for c in got)
        else:
            valid = 5 <= sum(c.isdigit() for c in got) <= 20
        if valid:
            self.add("account", start, stop)


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, stop) of all spans of a text, in order."""
    parse, lower = Parsers(text), text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for last, word in _anchors().iter(lower):
        if word == "@":
            parse.at_sign(last)
        elif word == "+":
            parse.plus(last)
        elif len(word) == 1:
            parse.digit(last)
        elif word == "://":
            parse.scheme(last - 2)
        else:
            parse.cue(last - len(word) + 1, word)
    spans, reach, out = sorted(parse.spans), {}, []
    base = [(s, e) for s, k, e in spans if k < len(BASE)]
    at, far = 0, -1
    for start, kind, stop in spans:  # an added span goes where a base span that starts no later ends no earlier
        while at < len(base) and base[at][0] <= start:
            far = max(far, base[at][1])
            at += 1
        if kind < len(BASE) or (far < stop and (start, stop) not in reach):
            reach[start, stop] = 1
            out.append((start, KINDS[kind], stop))
    return out


def _search(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    for b in batches:
        spans = [[{"kind": k, "start": s, "stop": e} for s, k, e in find(text.as_py())] if text.is_valid else [] for text in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id and spans, an array of (kind, start, stop) by start, then by kind as listed."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_search, f"doc_id long, spans {SPANS}")


def listed(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:stop of spans, of some kinds or all, joined by commas."""
    some = F.filter(spans, lambda s: s["kind"].isin(kinds)) if kinds else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def mask(text: str) -> str:
    """text with each span, or run of spans that overlap, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for start, kind, stop in find(text):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """docs with the spans of their texts masked; all columns stay as they are, null texts null."""
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            new = pa.array([t if t is None else mask(t) for t in b.column(place).to_pylist()], pa.string())
            yield b.set_column(place, b.schema.names[place], new)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
