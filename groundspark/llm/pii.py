"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and identifier cues. From an
anchor a deterministic local parser expands to both sides and validates what it has found. Spans are half-open and
counted in code points.

Base kinds follow fixed patterns, leftmost and non-overlapping within a kind, failing matches dropped without a retry:
``email``, ``ip`` (parts at most 255), ``card`` (14 to 19 digits passing Luhn), ``phone`` (10 to 15 digits). The method
adds: ``account`` (a whole group of 14 to 19 digits passing Luhn inside a longer chain that failed; a number of 6 digits
or more behind an account cue, with or without a word like "number" between them), ``secret`` (a quoted or bare value of
16 characters or more, or 6 for a password, with a digit, behind a cue and ``=`` or ``:``) and ``url`` (a scheme followed by a user name and password).

Contract: a null or empty text has no spans; texts of any length are read whole; repeated rows get equal results; empty
tables stay empty; further columns pass through, one with the name of the output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundspark.llm.common import replaced, small_batches, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret", "url")
#: Words, in lower case, that announce a number or a secret.
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "cuenta", "compte")
SECRET_CUES = ("token", "api_key", "apikey", "secret", "password", "passwd")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | DIGITS
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
DIALLED = DIGITS | frozenset(" ().-")
KEYED = ALNUM | frozenset("_-+/.")
LOWER = {k: k + 32 for k in range(65, 91)}
#: What can stand between an account cue and its number: separators, and filler words with separators around them.
GAP = re.compile(r"[ :#=.]{1,3}(?:(?:numbers?|num|nos?|nr|is)(?![a-z])[ :#=.]{0,3}){1,2}|[ :#=][ :#=.]{0,2}", re.I)
#: The least length of an assigned value, and of one that is said to be a password.
LEAST_SECRET, LEAST_PASSWORD = 16, 6


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small_part(digits: str) -> bool:
    """At most 255, whatever zeros lead."""
    short = digits.lstrip("0") or "0"
    return len(short) <= 3 and int(short) <= 255


def run_right(text: str, at: int, allowed: frozenset[str]) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def lowered(text: str) -> str:
    """In lower case, every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(LOWER)


class Finder:
    def __init__(self) -> None:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word, what in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((d, "digit") for d in "0123456789")]:
            machine.add_word(word, (what, len(word)))
        for cues, what in ((ACCOUNT_CUES, "account"), (SECRET_CUES, "secret")):
            for cue in cues:
                machine.add_word(cue, (what, len(cue)))
        machine.make_automaton()
        self.machine = machine

    def find(self, text: str | None) -> list[Span]:
        """All spans, by start, then kind as listed, then end."""
        if not text:
            return []
        out: list[Span] = []
        done = dict.fromkeys(("email", "number", "dotted", "account", "secret", "url"), 0)
        for last, (what, n) in self.machine.iter(lowered(text)):
            if what == "digit":
                if last >= done["number"]:
                    done["number"] = self.card(text, last, out)
                if last >= done["dotted"]:
                    done["dotted"] = self.dotted(text, last, out)
            elif what == "at":
                done["email"] = max(done["email"], self.email(text, last, done["email"], out))
            elif what == "plus":
                self.phone(text, last, out)
            elif what == "scheme":
                done["url"] = max(done["url"], self.url(text, last - n + 1, last + 1, done["url"], out))
            elif last + 1 - n >= done[what]:
                done[what] = max(last + 1, getattr(self, what)(text, last + 1, out))
        order = {k: i for i, k in enumerate(KINDS)}
        return sorted(set(out), key=lambda s: (s.start, order[s.kind], s.end))

    def email(self, text: str, at: int, free: int, out: list[Span]) -> int:
        """Left over the local part, not into the match before; right over two labels or more."""
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        end = run_right(text, at + 1, LABEL)
        if start == at or end == at + 1:
            return 0
        labels = 1
        while end < len(text) and text[end] == "." and (to := run_right(text, end + 1, LABEL)) > end + 1:
            end, labels = to, labels + 1
        if labels < 2:
            return 0
        out.append(Span("email", start, end))
        return end

    def dotted(self, text: str, at: int, out: list[Span]) -> int:
        """Four numbers joined by dots, from the first digit of a run on."""
        parts, end = [], at
        while len(parts) < 4:
            to = run_right(text, end, DIGITS)
            parts.append(text[end:to])
            end = to
            if len(parts) < 4:
                if end + 1 >= len(text) or text[end] != "." or text[end + 1] not in DIGITS:
                    return end
                end += 1
        if all(map(small_part, parts)):
            out.append(Span("ip", at, end))
        return end

    def card(self, text: str, at: int, out: list[Span]) -> int:
        """Digits with a single space or hyphen between some of them."""
        groups, end, n = [], at, len(text)
        while True:
            to = run_right(text, end, DIGITS)
            groups.append((end, to))
            end = to
            if end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
                end += 1
            else:
                break
        digits = "".join(text[a:b] for a, b in groups)
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(Span("card", at, end))
        elif len(groups) > 1:
            out += [Span("account", a, b) for a, b in groups if 14 <= b - a <= 19 and luhn(text[a:b])]
        return end

    def phone(self, text: str, at: int, out: list[Span]) -> None:
        if at + 1 >= len(text) or text[at + 1] not in DIGITS:
            return
        end = run_right(text, at + 2, DIALLED)
        while end > at + 2 and text[end - 1] not in DIGITS:
            end -= 1
        if end > at + 3 and 10 <= sum(c in DIGITS for c in text[at:end]) <= 15:
            out.append(Span("phone", at, end))

    def account(self, text: str, at: int, out: list[Span]) -> int:
        """A number behind the cue: letters, digits and single spaces or hyphens, with 6 digits or more."""
        gap = GAP.match(text, at)
        if not gap:
            return 0
        start = gap.end()
        end = run_right(text, start, ALNUM)
        while end + 1 < len(text) and text[end] in " -" and text[end + 1] in DIGITS:
            end = run_right(text, end + 1, ALNUM)
        if sum(c in DIGITS for c in text[start:end]) >= 6:
            out.append(Span("account", start, end))
            return end
        return 0

    def secret(self, text: str, at: int, out: list[Span]) -> int:
        """An assigned value with digits and letters."""
        to = run_right(text, at, frozenset(" "))
        if to - at > 2 or text[to : to + 1] not in ("=", ":"):
            return 0
        start = run_right(text, to + 1, frozenset(" \"'"))
        end, least = run_right(text, start, KEYED), LEAST_SECRET
        if lowered(text[max(0, at - 8) : at]).endswith(("password", "passwd")):
            least = LEAST_PASSWORD
            while end < len(text) and not text[end].isspace() and text[end] not in "\"'<>":
                end += 1
            while end > start and text[end - 1] in ".,;:)]}":
                end -= 1
        if start - to > 4 or end - start < least or not any(c in DIGITS for c in text[start:end]):
            return 0
        out.append(Span("secret", start, end))
        return end

    def url(self, text: str, at: int, rest: int, free: int, out: list[Span]) -> int:
        """A scheme with a user name, a colon and a password before the host."""
        start = at
        while start > free and text[start - 1] in ALNUM:
            start -= 1
        end = rest
        while end < len(text) and not text[end].isspace() and text[end] not in "\"'<>":
            end += 1
        host = text[rest:end].split("/", 1)[0]
        if start == at or "@" not in host or ":" not in host.rpartition("@")[0]:
            return 0
        out.append(Span("url", start, end))
        return end


@lru_cache(maxsize=1)
def finder() -> Finder:
    """One for each Python worker."""
    return Finder()


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each maximal stretch of overlapping spans replaced by the kind of its first one in angle brackets."""
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        while k < len(spans) and spans[k].start < end:
            end, k = max(end, spans[k].end), k + 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


def _mapped(df: DataFrame, text: str, name: str, kind: T.DataType, make) -> DataFrame:
    small_batches(df.sparkSession)
    schema = replaced(df.schema, name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = make(batch.column(text).to_pylist())
            columns = [values if f.name == name else batch.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def find(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Adds the spans of personal data as ``array<struct<kind, start, end>>``."""
    packed = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make(texts: list[str | None]) -> pa.Array:
        own = finder()
        return pa.array([[s._asdict() for s in own.find(t)] for t in texts], packed)

    return _mapped(df, text, spans, SPANS, make)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the spans in the text column by their kinds; texts without any, nulls among them, stay as they are."""
    order = df.columns

    def make(texts: list[str | None]) -> pa.Array:
        own = finder()
        return pa.array([redacted(t, own.find(t)) for t in texts], pa.string())

    return _mapped(df, text, text, T.StringType(), make).select(*order)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_pii(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))
