"""One consistent form for text whose characters merely look alike.

The skeleton of a text is found in three steps: decompose, replace every
character by its prototype from the public look-alike table, decompose again. Texts
that look the same have equal skeletons; originals are grouped by it. The
consistent form keeps what a reader sees but spells it with ordinary
characters: precomposed accents, plain spaces and hyphens, no invisible
characters, letters of normal width, no ligatures, and each word in one script.
A text can be inconsistent only where its skeleton differs from its mere
decomposition, where it is not composed or where a word mixes scripts; the form decides.

The table is Unicode's list of confusable characters, read from the ICU library that comes
with Spark, so it is neither copied here nor kept by hand. It also takes some ASCII
characters for each other (m for rn, 1 and I for l); forms and comparison
keys use only the prototypes of letters beyond ASCII.

Defined results: a null text has a null skeleton and form and is never
inconsistent; the empty text is consistent; texts of any length are treated as
a whole. Pure ASCII text is its own form, so the search for inconsistent rows drops
it in the JVM.
"""

from __future__ import annotations

import glob
import os
import struct
import unicodedata
import zipfile
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyspark
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that look like a basic Latin letter in some typefaces or sizes, beside those of the public table.
PROTOTYPES = {
    # Cyrillic
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ґ": "r", "ү": "y", "ѡ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V", "Ү": "Y", "Һ": "H", "З": "3",
    # Greek
    "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ϲ": "C", "Ϳ": "J",
    # Armenian and Cherokee
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Ս": "U", "Օ": "O", "Ѐ": "E",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Latin letters used in place of basic ones
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ſ": "s", "ʋ": "v", "ᴀ": "a", "ʙ": "b", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ɢ": "g", "ʜ": "h", "ɪ": "i", "ᴊ": "j", "ᴋ": "k", "ʟ": "l", "ᴍ": "m", "ɴ": "n", "ᴏ": "o", "ᴘ": "p", "ʀ": "r", "ꜱ": "s", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ʏ": "y", "ᴢ": "z",
}
# Characters drawn as a hyphen.
HYPHENS = "‐‑‒﹘﹣⁃˗"
# Invisible characters outside the general category Cf.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"
# Compatibility kinds that stand for an ordinary letter.
LETTER_KINDS = ("<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<circle>", "<square>")

@lru_cache(maxsize=1)
def look_alikes() -> dict[str, str]:
    """Character to prototype, of the table in ICU's binary form: a header, then keys (code point, length of the prototype),
    values (a code unit or where the string begins) and strings."""
    homes = [os.path.join(os.path.dirname(pyspark.__file__), "jars"), os.path.join(os.environ.get("SPARK_HOME", "."), "jars"), "__spark_libs__", "."]
    jars = [jar for home in homes for jar in sorted(glob.glob(os.path.join(home, "icu4j-*.jar")))]
    if not jars:
        raise FileNotFoundError("the icu4j library that comes with Spark is not in " + ", ".join(homes))
    with zipfile.ZipFile(jars[0]) as jar:
        data = jar.read("com/ibm/icu/impl/data/icudata/confusables.cfu")
    data = data[struct.unpack_from(">H", data)[0] :]
    keys_at, keys, values_at, values, strings_at, strings = struct.unpack_from(">6i", data, 12)
    out = {}
    for key, value in zip(struct.unpack_from(f">{keys}I", data, keys_at), struct.unpack_from(f">{values}H", data, values_at)):
        at, length = strings_at + 2 * value, (key >> 24) + 1
        out[chr(key & 0xFFFFFF)] = chr(value) if length == 1 else data[at : at + 2 * length].decode("utf-16-be")
    return out


WORD = regex.compile(r"[\p{L}\p{M}]+")
NON_ASCII = r"[^\x00-\x7F]"


@lru_cache(maxsize=65536)
def _plain(ch: str) -> str:
    """One character with spaces, hyphens, invisible and compatibility forms evened out."""
    kind = unicodedata.category(ch)
    if kind == "Cf" or ch in INVISIBLE or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if kind == "Zs":
        return " "
    if ch in HYPHENS:
        return "-"
    parts = unicodedata.decomposition(ch)
    if parts.startswith("<") and parts.split(" ", 1)[0] in LETTER_KINDS and (kind[0] in "LN" or parts.startswith(("<wide>", "<narrow>"))):
        return unicodedata.normalize("NFKC", ch)
    return ch


@lru_cache(maxsize=65536)
def _script(ch: str) -> str:
    """Script of a letter by its Unicode name; marks and modifiers belong to any script."""
    if unicodedata.category(ch)[0] != "L" or unicodedata.category(ch) == "Lm":
        return ""
    return unicodedata.name(ch, "UNKNOWN").split(" ", 1)[0].split("-", 1)[0]


@lru_cache(maxsize=65536)
def _latin(ch: str) -> str:
    """The basic Latin letter that a letter beyond ASCII looks like, or itself."""
    if ch in PROTOTYPES:
        return PROTOTYPES[ch]
    plain = look_alikes().get(ch, ch)
    if ch.isascii() or len(plain) > 1 or not plain.isascii() or not plain.isalpha() or unicodedata.category(ch)[0] != "L":
        return ch
    return "I" if plain == "l" and ch.isupper() else plain


def _one_script(match) -> str:
    word = match.group()
    seen = Counter(s for s in map(_script, word) if s)
    if len(seen) < 2:
        return word
    if not (set(seen) - {"HIRAGANA", "KATAKANA", "CJK", "HANGUL", "BOPOMOFO"}):
        return word  # these are written together
    return unicodedata.normalize("NFC", "".join(map(_latin, word))) if "LATIN" in seen else word


def consistent_form(text: str) -> str:
    if text.isascii():
        return text
    plain = unicodedata.normalize("NFC", "".join(map(_plain, text)))
    return WORD.sub(_one_script, plain)


def mixed_word(text: str) -> bool:
    for word in WORD.findall(text):
        if not word.isascii():
            seen = {s for s in map(_script, word) if s}
            if len(seen) > 1 and seen - {"HIRAGANA", "KATAKANA", "CJK", "HANGUL", "BOPOMOFO"}:
                return True
    return False


def inconsistent(text: str) -> bool:
    """Whether text differs from its consistent form, or mixes scripts in a way no prototype resolves."""
    if text.isascii():
        return False
    apart = unicodedata.normalize("NFD", text)
    if skeleton(text) == skeleton_of_plain(apart) and unicodedata.is_normalized("NFC", text):
        return mixed_word(text)
    return consistent_form(text) != text or mixed_word(text)


@lru_cache(maxsize=65536)
def _prototype(ch: str) -> str:
    """Prototype of one character; nothing for those that cannot be seen."""
    if unicodedata.category(ch) == "Cf" or ch in INVISIBLE or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    return look_alikes().get(ch) or look_alikes().get(_plain(ch), _plain(ch))


@lru_cache(maxsize=65536)
def _plain_prototype(ch: str) -> str:
    return _prototype(ch) if ch.isascii() else ch


def skeleton_of_plain(apart: str) -> str:
    """The skeleton of a decomposed text in which no character beyond ASCII has a prototype."""
    return unicodedata.normalize("NFD", "".join(map(_plain_prototype, apart)))


def skeleton(text: str) -> str:
    return unicodedata.normalize("NFD", "".join(map(_prototype, unicodedata.normalize("NFD", text))))


@lru_cache(maxsize=65536)
def _letter(ch: str) -> str:
    return "".join(map(_latin, _plain(ch)))


@lru_cache(maxsize=65536)
def _base(ch: str) -> str:
    if unicodedata.combining(ch):
        return ""
    return {"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ħ": "h", "ŧ": "t"}.get(ch, ch)


def comparison_key(text: str) -> str:
    """The text in ordinary letters, without case and accents: what similarity operators compare."""
    if text.isascii():
        return text.casefold()
    even = "".join(map(_letter, unicodedata.normalize("NFD", text)))
    return "".join(map(_base, unicodedata.normalize("NFD", even.casefold())))


def _unify_batch(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None, False) if t is None else (skeleton(t), consistent_form(t), inconsistent(t)) for t in texts]
    return pd.DataFrame(rows, columns=["skeleton", "form", "changed"])


def unify_text(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """df with skeleton, form and changed of the column text (names prefixed)."""
    unify = F.pandas_udf(_unify_batch, "struct<skeleton:string,form:string,changed:boolean>")
    return df.withColumn("__unified", unify(F.col(text))).select(
        *(c for c in df.columns if c not in [prefix + n for n in ("skeleton", "form", "changed")]), *(F.col(f"__unified.{n}").alias(prefix + n) for n in ("skeleton", "form", "changed"))
    )


def inconsistent_rows(df: DataFrame, text: str) -> DataFrame:
    """The rows of df whose text is not in the consistent form, with skeleton and form.

    Rows without a character beyond ASCII are dropped by a JVM filter before
    the Python stage; nothing is shuffled."""
    return unify_text(df.filter(F.col(text).rlike(NON_ASCII)), text).filter("changed")


def skeleton_groups(df: DataFrame, text: str) -> DataFrame:
    """Originals grouped by equal skeleton: skeleton, variants (distinct originals),
    rows, and the consistent form shared by most rows (ties: the smaller)."""
    counted = df.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("__original")).agg(F.count("*").alias("__rows"))
    forms = (
        unify_text(counted, "__original")
        .groupBy("skeleton", "form")
        .agg(F.count("*").alias("__variants"), F.sum("__rows").alias("__rows"))
    )
    return forms.groupBy("skeleton").agg(
        F.sum("__variants").alias("variants"),
        F.sum("__rows").alias("rows"),
        F.max_by("form", F.struct(F.col("__rows"), F.col("__variants"), -F.length("form"), F.col("form"))).alias("form"),
    )
