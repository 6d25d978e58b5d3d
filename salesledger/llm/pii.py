"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and cue words. From each anchor a
local parser widens to the left and right and checks what it has found: labels of an address, parts and ranges of
an IP, the Luhn sum of a card, digit counts of a phone, mod 97 of an IBAN, the shape of keys and passwords.
Every parser looks at a bounded neighbourhood or walks each character once, so a text of any length costs its length.
Secrets, keys, accounts and URL users have a least length but no greatest one: a span goes on to the last character of its class.

Defined cases: a null or empty text has no spans; offsets count code points and ends are exclusive; kinds may overlap
each other but a kind does not overlap itself; repeated rows are judged each on its own. Input columns that share a
name with a result column are replaced by the result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from salesledger.llm import textops as ops

#: Kinds that the base rules define, in their order, and kinds that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "key", "secret", "account", "url_user")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}

#: Words that announce an identifier, and prefixes of access keys.
CUES = {
    "secret": ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey"],
    "account": ["account", "acct", "konto", "cuenta", "compte", "passport", "ssn"],
    "key": ["AKIA", "ASIA", "ghp_", "sk_live_", "xoxb-"],
    "iban": ["IBAN"],
}
SCHEMES = ["http://", "https://", "ftp://"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
SECRET = re.compile(r"""[\t ]{0,3}(?:=|:|\bis\b)[\t ]{0,3}["']?([A-Za-z0-9+/_.~-]{8,})["']?""")
ACCOUNT = re.compile(r"[\t ]{0,3}(?:(?:no|nr|number|num)\.?)?[\t ]{0,3}[:#=]?[\t ]{0,3}((?:[A-Z]{0,2}[0-9][0-9 -]{4,}[0-9]))", re.I)
KEY = re.compile(r"[A-Za-z0-9_-]{12,}")
IBAN = re.compile(r"[\t :#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
USER = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    text = text.replace(" ", "")
    moved = text[4:] + text[:4]
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton():
    found: dict[str, set[str]] = {}
    for kind, words in [("email", ["@"]), ("phone", ["+"]), ("digit", [*"0123456789"]), ("url_user", SCHEMES), *CUES.items()]:
        for w in words:
            for form in {w} if kind in ("key", "iban") else {w, w.lower(), w.upper(), w.capitalize()}:
                found.setdefault(form, set()).add(kind)
    a = ahocorasick.Automaton()
    for w, kinds in found.items():
        a.add_word(w, (len(w), tuple(sorted(kinds))))
    a.make_automaton()
    return a


def _word_before(text: str, at: int) -> bool:
    return at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_")


def spans(text: str | None, anchors=None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind. anchors: an automaton to use again."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    last = dict.fromkeys((*ORDER, "run"), 0)  # the end of what each kind has consumed; run: of plain digits
    for end, (size, kinds) in (anchors or automaton()).iter(text):
        at, end = end + 1 - size, end + 1
        for kind in kinds:
            if kind == "email":
                left = at
                while left > last["email"] and text[left - 1] in LOCAL:
                    left -= 1
                if left < at and (m := DOMAIN.match(text, end)):
                    out.append((left, m.end(), "email"))
                    last["email"] = m.end()
            elif kind == "phone":
                if m := PHONE.match(text, at):
                    if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                        out.append((at, m.end(), "phone"))
            elif kind == "digit":
                if at < last["run"]:
                    continue
                last["run"] = DIGITS.match(text, at).end()
                if at >= last["ip"] and (m := IP.match(text, at)):
                    last["ip"] = m.end()
                    if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split(".")):
                        out.append((at, m.end(), "ip"))
                if at >= last["card"] and (m := CARD.match(text, at)):
                    last["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "") if len(m[0]) <= 37 else ""
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, m.end(), "card"))
            elif at >= last[kind] and not _word_before(text, at):
                if kind == "key":
                    m, a = KEY.match(text, end), at
                    ok = m and any(c.isdigit() for c in m[0]) and any(c.isupper() for c in m[0])
                    if m:
                        last[kind] = m.end()  # what a rejected run lacks, its rest lacks too
                elif kind == "iban":
                    m = IBAN.match(text, end)
                    while m and not iban_ok(m[1]) and " " in m[1]:  # a following word may have been taken in
                        m = IBAN.fullmatch(text, end, m.start(1) + m[1].rindex(" "))
                    a, ok = m and m.start(1), m and iban_ok(m[1])
                elif kind == "url_user":
                    m, a = USER.match(text, end), end
                    ok = m is not None
                else:
                    m = (SECRET if kind == "secret" else ACCOUNT).match(text, end)
                    a, ok = m and m.start(1), m and any(c.isdigit() for c in m[1])
                if ok:
                    stop = m.end() if kind in ("key", "url_user") else m.end(1)
                    out.append((a, stop, kind))
                    last[kind] = stop
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]], x[1]))


def digest(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each run of spans replaced by the upper-case name of its first kind in angle brackets."""
    parts, done = [], 0
    for a, b, kind in found:
        if a >= done:
            parts += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*parts, text[done:]])


MADE = [*(f"n_{k}" for k in BASE), "base_sha256", "spans", "masked"]


def find_personal_data(docs: DataFrame, text: str = "text", mask: bool = True) -> DataFrame:
    """`docs` with counts of the base kinds, the digest of base spans, all spans and the masked text (null stays null)."""
    made = MADE if mask else MADE[:-1]
    plain = docs.select(*(c for c in docs.columns if c not in made))
    kinds = [T.LongType()] * len(BASE) + [T.StringType()] * 3
    schema = T.StructType([*plain.schema.fields, *(T.StructField(c, k) for c, k in zip(made, kinds))])
    arrow, names = [pa.int64()] * len(BASE) + [pa.string()] * 3, schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for whole in batches:
            at = whole.schema.get_field_index(text)
            offs = ops.flat(whole.column(at))[1]
            for lo, hi in ops.pieces(offs):
                batch = whole.slice(lo, hi - lo)
                rows = []
                for value in batch.column(at).to_pylist():
                    found = spans(value, anchors)
                    base = [x for x in found if x[2] in BASE]
                    counts = [sum(x[2] == k for x in base) for k in BASE]
                    row = [*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(found)]
                    rows.append([*row, masked(value, found) if value else value][: len(made)])
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names)

    return plain.mapInArrow(run, schema)
