"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, schemes and
identifier cues.  Around each anchor a local parser expands to the boundaries of
an address, number or account and validates it.  Every parser moves forward
only, so a text costs time in proportion to its length.

Spans are code points, end exclusive, leftmost and not overlapping per kind.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.llm.batches import added, texts
from pairwell.llm.common import fresh

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\x00-\x20\"'<>\x7f-\xa0]++")
_IBAN = re.compile(r"[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?: (?i:no|number|nr)\.?)?[ :#]{1,3}([0-9][0-9-]{4,20}[0-9])")

#: Lengths of account numbers by country, as registered for ISO 13616.
IBAN_LENGTHS = {
    country: size for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
        32: "LC", 33: "RU",
    }.items() for country in countries.split()
}

#: Anchors and the parser each one calls.
CUES = {
    "email": ("@",), "phone": ("+",), "number": tuple("0123456789"),
    "url": ("http://", "https://", "ftp://"),
    "iban": ("IBAN", "Iban", "iban"), "account": ("account", "Account", "ACCOUNT", "acct", "Acct"),
}


@cache
def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for name, cues in CUES.items():
        for cue in cues:
            automaton.add_word(cue, (name, len(cue)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    """Whether a number of any length is at most 255."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _iban_size(given: str) -> int:
    """How many characters of ``given``, blanks included, are an account; 0 if none are.

    An account of a country with a registered length ends there, if the check
    digits hold, and otherwise where the whole of ``given`` ends; that of
    another country at the last place where they hold.
    """
    ends = [i + 1 for i, c in enumerate(given) if c != " "]
    registered = IBAN_LENGTHS.get(given[:2])
    sizes = [registered, len(ends)] if registered else range(len(ends), 14, -1)
    return next((ends[n - 1] for n in sizes if n <= len(ends) and _mod97(given[:ends[n - 1]].replace(" ", ""))), 0)


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    done = dict.fromkeys((*KINDS, "at"), 0)
    for end, (cue, size) in _anchors().iter(text):
        at = end - size + 1
        if cue == "number":
            if at >= done["card"]:
                m = _CARD.match(text, at)
                done["card"] = m.end()
                if m.end() - at >= 16:
                    digits = re.sub("[ -]", "", m[0])
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found.append(("card", at, m.end()))
            if at >= done["ip"]:
                if m := _IP.match(text, at):
                    done["ip"] = m.end()
                    if all(map(_small, m[0].split("."))):
                        found.append(("ip", at, m.end()))
                else:  # no start within this run of digits can do better
                    done["ip"] = _DIGITS.match(text, at).end()
        elif cue == "email":
            # What stands before the previous at-sign, or in a match, is out of reach.
            start, floor = at, max(done["email"], done["at"])
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            done["at"] = at + 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found.append(("email", start, m.end()))
                done["email"] = m.end()
        elif cue == "phone":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append(("phone", at, m.end()))
        elif cue == "url":
            if at >= done["url"] and (m := _URL.match(text, end + 1)):
                stop = at + len(text[at:m.end()].rstrip(".,;:!?)]}"))
                if stop > end + 1:
                    found.append(("url", at, stop))
                    done["url"] = stop
        elif cue == "iban":
            if at >= done["iban"] and (m := _IBAN.match(text, end + 1)):
                # What fails is not passed over: another cue may stand within it.
                if size := _iban_size(m[1]):
                    done["iban"] = m.start(1) + size
                    found.append(("iban", m.start(1), done["iban"]))
        elif at >= done["account"] and (m := _ACCOUNT.match(text, end + 1)):
            found.append(("account", m.start(1), m.end(1)))
            done["account"] = m.end()
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (order[s[0]], s[1]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by ``[KIND]``."""
    out, at = [], 0
    runs: list[list] = []
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if runs and start < runs[-1][1]:
            runs[-1][1] = max(end, runs[-1][1])
        else:
            runs.append([start, end, kind])
    for start, end, kind in runs:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` (columns ``keep``, all by default) with an array of spans, and its name.

    Null and empty texts have no spans; repeated rows are scanned each; an empty
    table gives an empty one.  The parsers only go forward, so a very long text
    costs in proportion.  The new column's name avoids those of ``docs``.
    """
    out = fresh(docs.columns, "spans")

    def work(cells: pa.Array) -> list[tuple]:
        return [([{"kind": k, "start": s, "end": e} for k, s, e in find(t)],) for t in texts(cells)]

    return added(docs, text, [(out, SPANS)], work, keep), out


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, and all spans as text; odd rows as in :func:`scan`."""
    found, out = scan(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", ["key"])
    named = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kinds: tuple[str, ...]) -> Column:
        return F.filter(out, lambda s: s["kind"].isin(*kinds))

    base = of(BASE)
    return found.select(
        F.col("key").alias(key), *(F.size(of((k,))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col(out)).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; a null text stays null, an empty table empty."""
    out = fresh(docs.columns, "redacted")

    def work(cells: pa.Array) -> list[tuple]:
        rows = []
        for cell in cells:
            body = cell.as_py()
            rows.append((body and redact(body, find(body)),))
        return rows

    made = added(docs, text, [(out, T.StringType())], work, [c for c in docs.columns if c != text])
    return made.select(*[F.col(f"`{out}`").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
