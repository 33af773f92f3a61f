"""Sentence splitting as two rewriting passes and a split; the patterns work in Java and in RE2 alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundspark.functions.text import collapsed

#: Words whose period ends no sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "rev", "hon", "gen",
    "col", "lt", "sgt", "capt", "cmdr", "adm", "gov", "sen", "rep", "pres",
    "approx", "est", "fig", "no", "vol", "op", "cf", "eg", "ie", "etc", "al",
    "inc", "ltd", "co", "corp", "dept", "univ", "assn", "bros",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct",
    "nov", "dec", "mon", "tue", "wed", "thu", "fri", "sat", "sun",
)
#: An abbreviation, a single letter or dotted letters, a period, and the white space that then isn't a boundary.
HELD = r"(?i)(^|[^a-z.])(" + "|".join(ABBREVIATIONS) + r"|[a-z]|[a-z.]*\.[a-z]+)\.([.!?]*[\"')\]]*)\s"
BOUNDARY = r"([.!?]+[\"')\]]*)\s+"
CUT, KEPT = "\x01", "\x02"


def split_sentences(text: Column) -> Column:
    """Sentences of a text; when in doubt it isn't split. Neighbouring initials share a delimiter, hence the two passes."""
    body = collapsed(F.coalesce(text, F.lit("")))
    for _ in range(2):
        body = F.regexp_replace(body, HELD, "$1$2.$3" + KEPT)
    pieces = F.split(F.regexp_replace(body, BOUNDARY, "$1" + CUT), CUT)
    return F.filter(F.transform(pieces, lambda p: F.trim(F.translate(p, KEPT, " "))), lambda p: p != "")
