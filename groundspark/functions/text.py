"""Text operators as column expressions: ids, answer normalisation, citation markers, overlap, rendering."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundspark.settings import ABSTAIN_REASONS, REFUSAL, SETTINGS

#: Words that carry no content, and articles.
STOPWORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "but",
    "is", "was", "are", "were", "be", "been", "being", "it", "its",
    "he", "she", "they", "his", "her", "their", "this", "that", "these",
    "those", "with", "as", "by", "from", "has", "have", "had", "who", "which",
    "what", "when", "where", "not", "also", "there",
)
ARTICLES = ("a", "an", "the")
PUNCTUATION = r"[!-/:-@\[-`{-~]"
MARKER = r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]"


#: Syllables of Hangul decompose by a rule: their number gives the letters of three rows.
HANGUL, FIRSTS, MIDDLES, LASTS = 0xAC00, 0x1100, 0x1161, 0x11A7


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition, without marks, is another character or none, and those where it is several."""
    short, long = {}, {}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or HANGUL <= code <= 0xD7A3:
            continue
        parts = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if parts != chr(code):
            (short if len(parts) < 2 else long)[chr(code)] = parts
    return short, long


SHORT, LONG = _decompositions()
#: Stands in no decomposition.
GAP = "\x1f"


def _ranges(codes: list[int]) -> str:
    """A character class of sorted code points."""
    out: list[list[int]] = []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


#: A class of many ranges is tested range by range for every character, so a text is looked through for them only if it has any
#: character beyond LATIN, or one of the few before it.
LATIN = 0x24F
SEVERAL = _ranges(sorted([*map(ord, LONG), *range(HANGUL, 0xD7A4)]))
MAYBE = _ranges(sorted([*(ord(c) for c in LONG if ord(c) <= LATIN), *range(LATIN + 1, 0xD800), *range(0xE000, sys.maxunicode + 1)]))


def _spelled(c: Column) -> Column:
    """A character's decomposition, if it has several characters. Tables are single literals, which keeps plans small."""
    at = F.instr(F.lit("".join(LONG)), c)
    number = F.ascii(c) - HANGUL
    row = lambda start, n: F.lit("".join(chr(start + k) for k in range(n)))
    pick = lambda start, n, k: F.substring(row(start, n), F.floor(k).cast("int") + 1, F.lit(1))
    last = F.when(number % 28 == 0, "").otherwise(pick(LASTS, 28, number % 28))
    syllable = F.concat(pick(FIRSTS, 19, number / 588), pick(MIDDLES, 21, (number % 588) / 28), last)
    parts = F.split(F.lit(GAP.join(LONG.values())), GAP)
    return F.when((number >= 0) & (number < 0xD7A4 - HANGUL), syllable).when(at > 0, F.get(parts, at - 1)).otherwise(c)


def folded(text: Column) -> Column:
    """Compatibility decomposition without combining marks. Texts of ASCII stay as they are; characters that become several are rare, so
    only texts with one are spelled out."""
    ordered = sorted(SHORT, key=lambda c: not SHORT[c])  # translate drops what has no counterpart at the end
    plain = F.translate(text, "".join(ordered), "".join(SHORT[c] for c in ordered))
    several = F.rlike(plain, F.lit(MAYBE)) & F.rlike(plain, F.lit(SEVERAL))
    whole = F.when(several, F.array_join(F.transform(F.split(plain, ""), _spelled), "")).otherwise(plain)
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), whole).otherwise(text)


def stripped(text: Column) -> Column:
    """Without white space at either end, line breaks included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_doc_id(raw: Column) -> Column:
    return F.replace(F.regexp_replace(stripped(raw), r"(?U)\s+", "_"), F.lit("::"), F.lit("__"))


def parse_chunk_id(chunk_id: Column) -> Column:
    """struct<doc_id, chunk_index>, split at the last separator; null where the tail is no number."""
    ok = F.regexp_like(chunk_id, F.lit(r"(?s)^.*::[0-9]+$"))
    part = lambda k: F.regexp_extract(chunk_id, r"(?s)^(.*)::([0-9]+)$", k)
    return F.when(ok, F.struct(part(1).alias("doc_id"), part(2).try_cast("int").alias("chunk_index")))


def normalized_words(text: Column) -> Column:
    """Words after accents, case and punctuation are gone, without articles. Punctuation goes before articles do."""
    plain = F.regexp_replace(F.lower(folded(text)), PUNCTUATION, "")
    words = F.split(F.regexp_replace(plain, r"(?U)\s+", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*ARTICLES))


def normalize_answer(text: Column) -> Column:
    return F.array_join(normalized_words(text), " ")


def content_words(text: Column) -> Column:
    return F.array_distinct(F.filter(normalized_words(text), lambda w: ~w.isin(*STOPWORDS)))


def contains_any(normalized: Column, golds: Column) -> Column:
    """Whether any normalised gold is inside a normalised text; empty ones on either side never match."""
    return (normalized != "") & F.exists(golds, lambda g: (g != "") & F.contains(normalized, g))


def answer_matches(prediction: Column, golds: Column) -> Column:
    return F.coalesce(contains_any(normalize_answer(prediction), F.transform(golds, normalize_answer)), F.lit(False))


def is_abstention(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit(REFUSAL))


def parse_answers(raw: Column) -> Column:
    """A JSON array of strings; anything else is the only answer."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))


def json_object_text(raw: Column) -> Column:
    """The JSON object in a model's reply: as it is, without code fences, or from the first to the last brace; else null."""
    bare = stripped(F.regexp_replace(stripped(raw), r"(?m)^```[a-z]*\n?|```$", ""))
    cut = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.startswith(stripped(c), F.lit("{")), c)
    return F.coalesce(valid(bare), valid(cut))


def citation_numbers(raw: Column) -> Column:
    """Distinct cited numbers in the order they are written."""
    groups = F.regexp_extract_all(raw, F.lit(MARKER), F.lit(1))
    split = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    return F.array_distinct(F.transform(split, lambda n: F.regexp_replace(n, r"\s", "").try_cast("int")))


def without_markers(raw: Column) -> Column:
    bare = F.regexp_replace(raw, MARKER, "")
    return collapsed(F.regexp_replace(bare, r"\s+([.,;:!?])", "$1"))


def overlap(words: Column, passage_words: Column) -> Column:
    """The share of a sentence's content words in a passage; 1 for a sentence without any."""
    n = F.size(words)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(words, passage_words)) / F.greatest(n, F.lit(1)))


def str_em(answer: Column, sets: Column, blanks: bool = False) -> Column:
    """The share of answer groups of which a member is in the answer; 0 without groups. A member that normalises to nothing is in every
    answer; one that is blank as it stands is in none, or with ``blanks`` in every one too."""
    body = normalize_answer(answer)
    inside = lambda a: F.contains(body, normalize_answer(a))
    hits = F.filter(sets, lambda g: F.exists(g, lambda a: inside(a) if blanks else (stripped(a) != "") & inside(a)))
    return F.when(F.size(sets) > 0, F.size(hits) / F.greatest(F.size(sets), F.lit(1))).otherwise(F.lit(0.0))


def rendered_passages(texts: Column, ids: Column | None = None) -> Column:
    """``[i] text`` joined by empty lines; with ids for the plain prompt."""
    label = lambda i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "))
    if ids is None:
        return F.array_join(F.transform(texts, lambda t, i: F.concat(label(i), t)), "\n\n")
    both = F.arrays_zip(texts.alias("t"), ids.alias("c"))
    return F.array_join(F.transform(both, lambda x, i: F.concat(label(i), F.lit("(id: "), x["c"], F.lit(") "), x["t"])), "\n\n")


def premise(texts: Column, limit: int = SETTINGS.max_premise_chars) -> Column:
    return F.left(F.array_join(texts, "\n\n"), F.lit(limit))


def cache_key(*parts: Column) -> Column:
    """32 hex digits over the parts as JSON."""
    named = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    return F.substring(F.sha2(F.to_json(named), 256), 1, 32)


def agreement_band(kappa: Column) -> Column:
    """Landis and Koch's names, by the least value of each band."""
    return (
        F.when(kappa >= 0.81, "almost perfect").when(kappa >= 0.61, "substantial").when(kappa >= 0.41, "moderate")
        .when(kappa >= 0.21, "fair").when(kappa >= 0.0, "slight").otherwise("poor (worse than chance)")
    )


def fmt(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.format_string("%.4f", value))


def abstain_explanation(reason: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ABSTAIN_REASONS.items() for x in pair])
    return F.element_at(known, reason)
