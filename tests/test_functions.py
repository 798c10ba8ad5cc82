import random

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import names, scalars, text
from quire.operators.tokens import stem_table


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_nested_parentheses_equal_the_recursive_pattern(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("ab(()) ,") for _ in range(rng.randint(0, 24))) for _ in range(1500)]
    values += ["", "()", "((", "))", "a(b(c)d)e", "(a)(b", "a)b(c)"]
    expected = [regex.sub(r"\([^()]*+(?:(?R)[^()]*)*+\)", "", v) for v in values]
    assert column(spark, values, names.strip_nested_parens) == expected


def test_author_chain_on_awkward_names(spark):
    values = [
        "A. B. Smith (MIT (Lab 2)), Jörg Müller and  Zoë X",
        "X,, ,Y, et al",
        " , ,",
        "O'Neil (unclosed, B",
        "Anderson and Sand and Co",
        "İx and éclair",
    ]
    got = column(spark, values, lambda c: names.join_names(names.author_list(c)))
    assert got[:5] == [
        "a b smith,jörg müller,zoë x",
        "x,y",
        "",
        "oneil unclosed,b",
        "anderson,sand,co",
    ]
    assert got[5].endswith("eclair")  # a combining mark is no word character


def test_older_author_chain_keeps_inner_blanks(spark):
    got = column(spark, ["Jörg M. X (a, b) and B"], lambda c: names.join_names(names.author_list_ascii(c)))
    assert got == ["j rg m  x,b"]


TEXTS = st.text(alphabet=st.sampled_from(list("ab \t\n\r\x0b\x0c\x1c\x1f\x85\xa0    　​́€\U0001f600-'")), max_size=30)


@settings(max_examples=15, deadline=None)
@given(st.lists(TEXTS, min_size=20, max_size=40))
def test_words_equal_python_split(spark, values):
    assert column(spark, values, scalars.words) == [v.split() for v in values]
    assert column(spark, values, scalars.word_count) == [len(v.split()) for v in values]


def test_word_count_of_null(spark):
    assert column(spark, [None], scalars.word_count) == [None]
    assert column(spark, [None], lambda c: scalars.word_count(c, null_as_word=True)) == [1]


def test_dates_and_identifiers(spark):
    dates = ["1999-01-02", "bad-date", None, "0999-1", "3000-1", "x1999", "20"]
    assert column(spark, dates, scalars.year_of) == [1999, None, None, 999, 3000, None, 20]
    assert column(spark, dates, scalars.year_matched) == [1999, None, None, None, None, None, None]
    dois = ["10.1/a/b", "noslash", None, "/x"]
    assert column(spark, dois, scalars.doi_prefix) == ["10.1/", None, None, "/"]
    assert column(spark, ["a.b.c", "hep-th", ""], scalars.general_category) == ["a", "hep-th", ""]


def test_elapsed_text(spark):
    seconds = [0.0, 59.5, 60.5, 3661.0, 86399.6, 86400.0, 200000.0]
    got = column(spark, seconds, scalars.hms, "double")
    assert got == ["0:00:00", "0:01:00", "0:01:00", "1:01:01", "1 day, 0:00:00", "1 day, 0:00:00", "2 days, 7:33:20"]


def test_argmax_takes_the_first_largest(spark):
    assert column(spark, [[1.0, 3.0, 3.0], [2.0]], scalars.argmax, "array<double>") == [1, 0]


def test_rounding_is_half_to_even(spark):
    assert column(spark, [0.125, 0.135, 2.5], scalars.round_even, "double") == [0.12, 0.14, 2.5]


def test_json_pairs(spark):
    assert column(spark, ['{"a": 1, "b": "x"}'], scalars.json_pairs) == [{"a": "1", "b": "x"}]


def test_text_cleaning(spark):
    values = ["A-b_C 12é it's  CANNOT gonna", ""]
    assert column(spark, values, text.clean_letters) == ["a b c it s cannot gonna", ""]
    assert column(spark, values, text.clean_alphanumerics) == ["a b c 12 it s cannot gonna", ""]
    assert column(spark, values, text.long_word_text) == ["can not gon", ""]
    assert column(spark, values, text.alphanumeric_tokens)[1] == []


def test_ngrams(spark):
    rows = [["a", "b", "c"], ["a"], []]
    got = column(spark, rows, lambda c: text.ngrams(c, 1, 3), "array<string>")
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_stop_words_may_be_given(spark):
    assert column(spark, [["the", "cat"]], text.drop_stop_words, "array<string>") == [["cat"]]
    kept = column(spark, [["the", "cat"]], lambda c: text.drop_stop_words(c, ["cat"]), "array<string>")
    assert kept == [["the"]]


# Published sample of words and stems.
STEMS = """
consign consign, consigned consign, consignment consign, consistency consist, consistently consist,
consolation consol, consolatory consolatori, consolidating consolid, consolingly consol,
consonant conson, conspicuously conspicu, conspiracy conspiraci, conspirators conspir,
constable constabl, constancy constanc, knackeries knackeri, knaves knave, kneaded knead,
knees knee, knightly knight, knitted knit, generously generous, generation generat,
communication communic, hopping hop, hoping hope, agreed agre, feed feed, ties tie, cries cri,
gas gas, gaps gap, cry cri, by by, say say, happy happi, relational relat, conditional condit,
sensitivity sensit, digitizer digit, formalize formal, electrical electr, goodness good,
adjustable adjust, adoption adopt, rate rate, hopelessly hopeless, apologies apolog, youth youth,
boyish boyish, flying fli, luxuriated luxuri, skies sky, news news, dependent depend, a a
"""


def test_stems(spark):
    pairs = dict(p.split() for p in STEMS.replace("\n", " ").split(","))
    df = spark.createDataFrame([(list(pairs),)], "tokens array<string>")
    assert {r.token: r.stem for r in stem_table(df).collect()} == pairs
