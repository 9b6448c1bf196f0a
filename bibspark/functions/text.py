"""Text functions: folding, tokens, name suffixes, title and author normal forms.

Column functions stay in the JVM wherever Spark has the operation. Spark has no
Unicode normalisation, so the folds call an Arrow UDF for values with a
character beyond ASCII and plain lower() for all others; the UDF's input is
null for the rows it does not decide.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NON_ASCII = r"[^\x00-\x7F]"
WORD = r"([\p{L}\p{N}_]+)"
TOKEN = r"([\p{L}\p{N}]+)"
_PY_WORD = re.compile(r"\w+", re.UNICODE)
_PY_TOKEN = re.compile(r"[^\W_]+", re.UNICODE)


def fold_accents(value: str) -> str:
    """Case folded, compatibility decomposed, without combining marks: for author lookups and titles."""
    if value.isascii():
        return value.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", value.casefold()) if not unicodedata.combining(c))


@lru_cache(maxsize=65536)
def _index_char(ch: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", ch.lower()) if not unicodedata.combining(c)))


def fold_index(value: str) -> str:
    """The full-text index's fold: lower case without diacritics, compatibility characters kept."""
    return value.lower() if value.isascii() else "".join(map(_index_char, value))


def _lazy(fn):
    def batch(values: pd.Series) -> pd.Series:
        return values.map(lambda v: fn(v) if isinstance(v, str) else None)

    def column(value: Column) -> Column:
        odd = value.rlike(NON_ASCII)
        run = F.pandas_udf(batch, "string")
        return F.when(odd, run(F.when(odd, value))).otherwise(F.lower(value))

    column.__doc__ = fn.__doc__
    return column


fold = _lazy(fold_accents)
index_fold = _lazy(fold_index)
casefold = _lazy(lambda v: v.casefold())


def query_words(text: str, most: int) -> list[str]:
    return _PY_WORD.findall(text)[:most]


def query_tokens(word: str) -> list[str]:
    """A query word as the index splits it: an underscore separates tokens of a phrase."""
    return _PY_TOKEN.findall(fold_index(word))


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(index_fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 1)


def name_suffixes(folded: Column) -> Column:
    """Every proper suffix of a folded name, a trailing four-digit number off: from its second word on."""
    bare = F.trim(F.regexp_replace(folded, r"\s+[0-9]{4}$", ""))
    parts = F.filter(F.split(bare, r"\s+"), lambda p: p != "")
    places = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(parts, i, F.size(parts)), " "))


def normalized_title(title: Column) -> Column:
    """Folded words joined by a blank; notes on the edition and apostrophes inside words are dropped."""
    text = fold(F.coalesce(title, F.lit("")))
    text = F.regexp_replace(text, r"\((preliminary version|extended abstract|abstract)\)", " ")
    text = F.regexp_replace(text, r"(?<=[\p{L}\p{N}_])['’](?=[\p{L}\p{N}_])", "")
    return F.array_join(words(text), " ")


def author_identity(authors: Column, key: Column) -> Column:
    """The sorted multiset of a record's names; a record without any is identified by its key."""
    names = F.transform(F.split(casefold(F.coalesce(authors, F.lit(""))), ", "), lambda n: F.trim(F.regexp_replace(n, r"\s+", " ")))
    kept = F.array_sort(F.filter(names, lambda n: n != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.concat(F.lit("key:"), key)))
