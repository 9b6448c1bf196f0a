import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from bibspark.llm import skeleton as s

FINE = ["", "plain text", "Jürgen Øre", "λ-calculus for all", "Ένα πλαίσιο", "Разреженные графы", "日本語のテキスト", "a — b", "x² ½ €", "Łukasz O'Neil"]
ODD = {
    "José": "José", "a b": "a b", "a‑b": "a-b", "zero​width﻿": "zerowidth", "Ｆａｒｉｄ": "Farid", "ﬁne": "fine",
    "Sеlum": "Selum", "Κatherine": "Katherine", "so­ft": "soft", "\u212a": "K", "οιλoς": None, "ａ１": "a1", "Μеi": None,
}


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert not s.inconsistent(text) and s.consistent_form(text) == text


@pytest.mark.parametrize("text", ODD)
def test_odd(text):
    assert s.inconsistent(text)
    if ODD[text] is not None:
        assert s.consistent_form(text) == ODD[text] and not s.inconsistent(ODD[text])


def test_same_looks_have_one_skeleton():
    assert len({s.skeleton(x) for x in ("Farid", "Fаrid", "Ｆarid", "Fa​rid")}) == 1
    assert s.skeleton("José") == s.skeleton("José") and s.skeleton("Jose") != s.skeleton("José")
    assert s.comparison_key("STRASSE Øre") == s.comparison_key("straße øre") == "strasse ore"


def test_public_table():
    table = s.look_alikes()
    assert len(table) > 6000 and table["а"] == "a" and table["ﬁ"] == "fi" and table["m"] == "rn" and table["Ｏ"] == "O"
    # A word wholly in another script is fine, but one with the word that looks like it.
    assert s.skeleton("расе") == s.skeleton("pace") and not s.inconsistent("расе") and s.inconsistent("pасе")
    assert s.comparison_key("modem 10 Il") == "modem 10 il"


def test_gate_loses_nothing():
    import random

    rng = random.Random(4)
    marks = ["а", "é", "e\u0301", "Ｆ", "ﬁ", "\u200b", "\u00a0", "‑", "я", "κ", "日", "ー", "²", "½", "Ꭺ", "ı", "—", "İ", "ø", "\u0338"]
    for _ in range(3000):
        text = "".join(rng.choice(marks) if rng.random() < 0.2 else rng.choice("abc mI1 ") for _ in range(rng.randrange(1, 14)))
        assert s.inconsistent(text) == (not text.isascii() and (s.consistent_form(text) != text or s.mixed_word(text))), ascii(text)


@given(st.text(max_size=30))
def test_laws(text):
    form = s.consistent_form(text)
    assert s.consistent_form(form) == form
    assert s.skeleton(s.skeleton(text)) == s.skeleton(text)
    assert unicodedata.is_normalized("NFC", form) or text.isascii()


def test_rows(spark):
    rows = [(1, "plain", "x"), (2, None, "x"), (3, "", "x"), (4, "Sеlum", "y"), (4, "Sеlum", "y"), (5, "Selum", None), (6, "я" * 50_000, None), (7, "a" * 100_000 + "​", None)]
    df = spark.createDataFrame(rows, "id int, text string, form string")
    assert sorted(r["id"] for r in s.inconsistent_rows(df.select("id", "text"), "text").collect()) == [4, 4, 7]
    groups = {r["skeleton"]: (r["variants"], r["rows"], r["form"]) for r in s.skeleton_groups(df, "text").collect()}
    assert groups[s.skeleton("Selum")] == (2, 3, "Selum") and groups[""] == (1, 1, "")
    assert s.inconsistent_rows(df.limit(0).select("id", "text"), "text").count() == 0
