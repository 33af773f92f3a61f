"""Scalar operators on tables of cases."""

import pytest
from pyspark.sql import functions as F

from groundspark.functions import text as T
from groundspark.functions.sentences import split_sentences


def values(spark, kind, cases, make):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_sentence_counts(spark):
    cases = {
        "Rain fell. Rivers rose! Who knew?": 3,
        "Prof. Ito met Sgt. Okafor at noon. They talked.": 2,
        "It was K. L. M. Berg who built the mill. It burnt down in 1802.": 2,
        "He left the U.K. in May. Nobody wrote to him.": 2,
        "Pi is near 3.1416 here. Fine.": 2,
        "Bring ropes, lamps, etc. Leave the tent.": 1,
        "Someone cried 'run!' Then it was still.": 2,
        'A sign read "closed." We went home.': 2,
        "": 0,
        "\t \n": 0,
        "no mark at the end": 1,
    }
    got = values(spark, "string", list(cases), split_sentences)
    assert [len(x) for x in got] == list(cases.values())
    assert got[7][0].endswith('."')


def test_citations(spark):
    cases = [
        ("Tea grows on hills [4].", [4], "Tea grows on hills."),
        ("[7] Salt dissolves.", [7], "Salt dissolves."),
        ("Bees dance [2][6].", [2, 6], "Bees dance."),
        ("Bees dance [2, 6].", [2, 6], "Bees dance."),
        ("Iron rusts [8,3][12] in rain.", [8, 3, 12], "Iron rusts in rain."),
        ("Glass melts [5][9][5].", [5, 9], "Glass melts."),
        ("Open [3 bracket.", [], "Open [3 bracket."),
        ("Names [x] and [a::1] stay.", [], "Names [x] and [a::1] stay."),
        ("Space before [1] , then on.", [1], "Space before, then on."),
    ]
    raws = [c[0] for c in cases]
    assert values(spark, "string", raws, T.citation_numbers) == [c[1] for c in cases]
    assert values(spark, "string", raws, T.without_markers) == [c[2] for c in cases]


def test_folding_equals_the_standard(spark):
    import unicodedata

    want = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    cases = ["Ελλάδα", "йод Ёж", "ﬁne ﬄuent ½ ™ ㈱ ﷺ", "Ａbc１２", "한국어 값 가", "e\u0301 a\u0300\u0323", "𝔘𝔫𝔦 𝟙", "Łódź ß", "नि क़", "漢字 ㍿ 豈", "plain", "", "ｶﾞ ゔ"]
    assert values(spark, "string", cases, T.folded) == [want(c) for c in cases]
    every = ["".join(chr(c) for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0x80, 0x30000, 64)]
    assert values(spark, "string", every, T.folded) == [want(c) for c in every]
    assert values(spark, "string", ["Ελλάδα", "ﬁne", "Ａbc"], T.normalize_answer) == ["ελλαδα", "fine", "abc"]


def test_ids(spark):
    assert values(spark, "string", [" Some  Doc\n", "weird::title"], T.normalize_doc_id) == ["Some_Doc", "weird__title"]
    got = values(spark, "string", ["a::b::3", "no-separator", "doc::notanumber", ""], T.parse_chunk_id)
    assert (got[0]["doc_id"], got[0]["chunk_index"]) == ("a::b", 3) and got[1:] == [None, None, None]


def test_normalisation_and_matching(spark):
    cases = ["The Politician.", "the-cat", "Él niño, an É", "  A\n the AN ", ""]
    assert values(spark, "string", cases, T.normalize_answer) == ["politician", "thecat", "el nino e", "", ""]
    golds = F.array(F.lit("The"), F.lit("Politician"))
    assert values(spark, "string", ["He was a politician", "nobody", ""], lambda x: T.answer_matches(x, golds)) == [True, False, False]
    assert values(spark, "string", ["I CANNOT answer this from the provided sources."], T.is_abstention) == [True]


def test_json_and_answers(spark):
    assert values(spark, "string", ['["a","b"]', "plain ["], T.parse_answers) == [["a", "b"], ["plain ["]]
    cases = ['{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": 1} ok', "none", "{broken"]
    assert values(spark, "string", cases, T.json_object_text) == ['{"a": 1}', '{"a": 1}', '{"a": 1}', None, None]


def test_str_em_and_overlap(spark):
    sets = F.array(F.array(F.lit("Paris"), F.lit("Lutetia")), F.array(F.lit("Rome")))
    assert values(spark, "string", ["It is paris.", "x"], lambda x: T.str_em(x, sets)) == [0.5, 0.0]
    df = spark.sql("SELECT array('a','b') AS w, array('b') AS p, array() AS none")
    assert df.select(T.overlap(F.col("w"), F.col("p")), T.overlap(F.col("none").cast("array<string>"), F.col("p"))).first()[:] == (0.5, 1.0)


def test_blank_members_of_str_em(spark):
    sets = F.array(F.array(F.lit(" \n")), F.array(F.lit("the"), F.lit("x")), F.array(F.lit(None).cast("string")), F.array(F.lit(" "), F.lit("paris")))
    cases = ["It is Paris.", "Rome", "", None]
    assert values(spark, "string", cases, lambda x: T.str_em(x, sets)) == [0.5, 0.25, 0.25, 0.0]
    assert values(spark, "string", cases, lambda x: T.str_em(x, sets, blanks=True)) == [0.75, 0.75, 0.75, 0.0]


@pytest.mark.parametrize(("kappa", "band"), [(-0.1, "poor (worse than chance)"), (0.0, "slight"), (0.21, "fair"), (0.5, "moderate"), (0.61, "substantial"), (0.9, "almost perfect")])
def test_bands(spark, kappa, band):
    assert spark.range(1).select(T.agreement_band(F.lit(kappa))).first()[0] == band


def test_rendering(spark):
    df = spark.sql("SELECT array('x','y') AS t, array('a::0','b::1') AS c")
    assert df.select(T.rendered_passages(F.col("t")), T.rendered_passages(F.col("t"), F.col("c")), T.fmt(F.lit(0.12345)), T.fmt(F.lit(None).cast("double"))).first()[:] == ("[1] x\n\n[2] y", "[1] (id: a::0) x\n\n[2] (id: b::1) y", "0.1235", "")
