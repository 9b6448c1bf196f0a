"""A search request as a plan: validated arguments and the phrases they ask for."""

from __future__ import annotations

from dataclasses import dataclass, field

from bibspark.functions.records import CATEGORIES
from bibspark.functions.text import query_tokens, query_words

# Columns of the index and their weights.
COLUMNS = ("title", "authors", "venue", "venue_aliases")
SEARCH_WEIGHTS = (5.0, 1.0, 2.0, 3.0)
TITLE_WEIGHTS = (5.0, 0.0, 0.0, 0.0)
LIMITS = {"q": 200, "author": 150, "venue": 150, "key": 300}


@dataclass(frozen=True)
class Phrase:
    """Adjacent tokens, the last perhaps a prefix, in some columns; clause numbers are AND-ed."""

    tokens: tuple[str, ...]
    prefix: bool
    columns: tuple[int, ...] = (0, 1, 2, 3)
    clause: int = 0


@dataclass(frozen=True)
class QuerySpec:
    phrases: tuple[Phrase, ...] = ()
    clauses: int = 0
    author: str = ""
    author_exact: bool = False
    year_from: int | None = None
    year_to: int | None = None
    record_type: str = ""
    categories: frozenset[str] = frozenset()
    limit: int = 20
    offset: int = 0
    sort: str = "relevance"
    empty: bool = False
    extra: dict = field(default_factory=dict, compare=False)


def match_phrases(text: str, most: int = 12, clause: int = 0, columns: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3),)) -> list[Phrase]:
    """One clause per word, the last a prefix; each with one alternative per set of columns."""
    words = query_words(text, most)
    return [
        Phrase(tuple(query_tokens(w)), k == len(words) - 1, c, clause + k)
        for k, w in enumerate(words)
        for c in columns
    ]


def number(value, name: str, low: int, high: int) -> int | None:
    if value is None or value == "":
        return None
    try:
        parsed = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a whole number") from None
    if not low <= parsed <= high:
        raise ValueError(f"{name} must lie between {low} and {high}")
    return parsed


def checked_length(value: str, name: str) -> str:
    if len(value) > LIMITS[name]:
        raise ValueError(f"{name} is longer than {LIMITS[name]} characters")
    return value


def plan(q="", author="", venue="", year_from=None, year_to=None, record_type="", limit=20, offset=0, sort="relevance", category="", author_exact=False) -> QuerySpec:
    """The plan of a request; empty where nothing can match, ValueError where it is malformed."""
    q, author, venue = q.strip(), author.strip().casefold(), venue.strip()
    phrases: list[Phrase] = []
    empty = False
    if q:
        phrases += match_phrases(q)
        empty |= not phrases
    if venue:
        start = len({p.clause for p in phrases})
        found = match_phrases(venue, 8, start, ((2,), (3,)))
        empty |= not found
        phrases += found
    kinds = frozenset(part.strip() for part in category.split(",")) if category else frozenset()
    if not kinds <= set(CATEGORIES):
        raise ValueError("category must be of " + ", ".join(CATEGORIES))
    if not (phrases or author or year_from is not None or year_to is not None or record_type or kinds):
        empty = True
    # A word that holds no token (only underscores) matches nothing, and so does the conjunction.
    empty |= any(not p.tokens for p in phrases)
    return QuerySpec(
        tuple(phrases), len({p.clause for p in phrases}), author, author_exact, year_from, year_to, record_type, kinds, limit, offset,
        sort if sort in ("year_desc", "year_asc") else "relevance", empty,
    )
