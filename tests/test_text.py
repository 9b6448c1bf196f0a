import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibspark.functions import bibtex, text, venues


def values(spark, rows, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r[1] for r in sorted(df.select("i", column(F.col("v")).alias("o")).collect())]


def test_folds_differ_on_purpose(spark):
    rows = ["Straße", "Øre", "ﬁne", "Núñez", "ABC", "", None]
    assert values(spark, rows, text.fold) == ["strasse", "øre", "fine", "nunez", "abc", "", None]
    assert values(spark, rows, text.index_fold) == ["straße", "øre", "ﬁne", "nunez", "abc", "", None]


def test_suffixes_leave_the_number_off(spark):
    got = values(spark, ["ana maria de sousa 0003", "solo", "", "two words"], text.name_suffixes)
    assert got == [["maria de sousa", "de sousa", "sousa"], [], [], ["words"]]


def test_normalized_title(spark):
    rows = ["The Cat's Cradle (Extended Abstract)", "well-known  results (preliminary version).", "snake_case", None]
    assert values(spark, rows, text.normalized_title) == ["the cats cradle", "well known results", "snake_case", ""]


def test_author_identity_is_a_sorted_multiset(spark):
    df = spark.createDataFrame([("Bea  Ng, ada Lo, Bea Ng", "k1"), ("", "k2"), (None, "k3"), (", ", "k4")], "a string, k string")
    got = [r[0] for r in df.select(text.author_identity(F.col("a"), F.col("k"))).collect()]
    assert got == [["ada lo", "bea ng", "bea ng"], ["key:k2"], ["key:k3"], ["key:k4"]]


def test_query_words_and_tokens():
    assert text.query_words("foo_bar-baz  qux", 12) == ["foo_bar", "baz", "qux"]
    assert text.query_tokens("Foo_Bär") == ["foo", "bar"]
    assert text.query_tokens("___") == []


def test_escape_is_single_pass(spark):
    assert values(spark, [r"\&%$#_{}~^", "plain", None], bibtex.escape) == [
        r"\textbackslash{}\&\%\$\#\_\{\}\textasciitilde{}\textasciicircum{}", "plain", None,
    ]


def test_entry_links(spark):
    df = spark.createDataFrame([("a/b", "article", "https://dx.DOI.org/10.1/x_y"), ("c/d", "www", ""), ("e/f", "data", None)], "k string, t string, ee string")
    got = [r[0] for r in df.select(bibtex.entry(F.col("k"), F.col("t"), {"title": F.lit("A & B"), "doi": F.lit("own")}, F.col("ee"))).collect()]
    assert got[0] == "@article{DBLP:a/b,\n  title = {A \\& B},\n  doi = {10.1/x\\_y},\n  url = {https://dx.DOI.org/10.1/x\\_y},\n}\n"
    assert got[1].startswith("@misc{DBLP:c/d,") and "doi = {own}" in got[1] and got[1].count("rec/c/d") == 1
    assert got[2].startswith("@misc{DBLP:e/f,")


def test_venue_aliases(spark):
    rows = ["ACM Trans. Database Syst.", "IEEE Journal of Odd Things", "ICDX", "PMQ@ICDX", "", None, "Électron", "of the"]
    got = values(spark, rows, venues.aliases)
    assert got[0] == "ACM ACMTDS ATDS TDS TODS"
    assert got[1] == "IEEE IEEEJOT IJOT JOT"
    assert got[2:] == ["ICDX", "ICDX PI PMQ PMQICDX", "", "", "", ""]


@given(st.text(max_size=40))
def test_python_folds_never_fail(value):
    assert isinstance(text.fold_accents(value), str) and isinstance(text.fold_index(value), str)
    assert not re.search(r"[A-Z]", text.fold_index(value))


@pytest.mark.parametrize("value", ["", "A", "Ж", "ﬃ"])
def test_ascii_shortcut_agrees(value):
    assert text.fold_index(value + "é")[:-1] == text.fold_index(value)
