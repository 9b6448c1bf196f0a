"""Spelling variants of names typed by people, linked into entities.

Candidates come from a symmetric-delete index over the distinct tokens: it finds
the commoner tokens each may be a spelling of, so of two that are alike one
stands for both. A name is then filed under every two of its tokens, or a token
and the initial of another, so names meet whatever the order of their parts.
Candidates are verified by an optimal assignment of their tokens that permits
slips, initials, abbreviations, nicknames and left-out middle parts.

A person id is an entity of its own, so only names never seen with an id are
compared, with all others. Each joins the entity it fits strictly best; a name
that fits two entities equally well (an initial, say) stays by itself. Names
seen so often without an id that chance cannot explain it are entities without
id; the test uses the mean share of missing ids over all names that have one.

Every pair of names that compare accepts meets under a key: two spelled-out names
only under two tokens they share, an abbreviated one under a token and an initial.
Nothing is capped, and no key depends on how many names share it.

Defined results: null and blank names have no entity; repeated rows only add
to a name's count; names that carry different four-digit numbers, or one and
none, never match; a name without letters matches only by its id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bibspark.llm.skeleton import comparison_key
from bibspark.runtime import cut

# Common short forms of given names.
NICKNAMES = {
    "al": "albert alan", "alex": "alexander alexandra", "andy": "andrew", "drew": "andrew", "annie": "anna anne", "anya": "anna", "art": "arthur", "barb": "barbara", "basia": "barbara", "becky": "rebecca", "becca": "rebecca",
    "ben": "benjamin", "benny": "benjamin", "bert": "albert robert", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine katherine",
    "charlie": "charles", "chuck": "charles", "chris": "christopher christina", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "dima": "dmitri", "mitya": "dmitri",
    "don": "donald", "ed": "edward edwin", "eddie": "edward", "eliza": "elizabeth", "ellie": "eleanor", "nell": "eleanor helena", "nora": "eleanor", "lena": "helena", "francie": "frances", "frank": "francis francisco", "paco": "francisco", "pancho": "francisco",
    "fred": "frederick", "freddy": "frederick", "gabby": "gabriella", "gabe": "gabriel", "gene": "eugene", "gerry": "gerald", "greg": "gregory", "hal": "harold", "harry": "harold henry", "hank": "henry", "hans": "johannes johan", "jack": "john jonathan", "jan": "johan janet",
    "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "jon": "jonathan", "johnny": "john", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kit": "christopher", "ken": "kenneth", "kenny": "kenneth", "larry": "lawrence", "len": "leonard leonardo", "leo": "leonardo leonard",
    "liz": "elizabeth", "lizzie": "elizabeth", "lou": "louis louise", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "marge": "margaret marguerite", "matt": "matthew", "mel": "melanie", "mick": "michael", "mike": "michael", "misha": "mikhail michael", "nat": "nathaniel", "nate": "nathaniel", "ned": "edward", "nick": "nicholas",
    "nicky": "nicholas", "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "pepe": "jose", "pete": "peter", "phil": "philip", "pippa": "philippa", "ray": "raymond", "rick": "richard", "rich": "richard", "rob": "robert", "ron": "ronald", "rosie": "rosalind", "roz": "rosalind", "sam": "samuel samantha", "sandy": "alexander",
    "sasha": "alexander", "sally": "sarah", "sergio": "sergei", "steph": "stephanie", "steve": "stephen steven", "sue": "susan", "ted": "theodore edward", "teddy": "theodore", "theo": "theodore", "tim": "timothy", "tom": "thomas tomas", "tommy": "thomas", "tony": "anthony", "val": "valentina", "vic": "victor victoria", "vicky": "victoria", "tori": "victoria", "walt": "walter", "wally": "walter",
    "will": "william", "willy": "william wilhelmina", "mina": "wilhelmina", "zach": "zachary", "zack": "zachary", "bella": "isabella", "izzy": "isabella", "juan": "johan", "kolya": "nikolai", "lulu": "leila", "vitya": "viktor", "nadya": "nadia", "olly": "oliver olivia", "liv": "olivia",
}
# Short forms of words in the names of organisations.
ORGANISATION_WORDS = {
    "dept": "department", "dep": "department", "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory", "univ": "university", "uni": "university", "inst": "institute", "assoc": "association", "assn": "association", "asso": "association",
    "found": "foundation", "fdn": "foundation", "ctr": "centre", "cent": "centre", "center": "centre", "intl": "international", "int": "international", "natl": "national", "nat": "national", "acad": "academy", "soc": "society", "coll": "college",
    "collab": "collaboration", "consort": "consortium", "fac": "faculty", "sch": "school", "corp": "corporation", "co": "company", "grp": "group", "tech": "technology", "sci": "sciences", "eng": "engineering", "res": "research",
}
ORGANISATION_MARKS = frozenset(ORGANISATION_WORDS.values()) | {"observatory", "council", "agency", "committee", "team", "project", "network", "hospital", "ministry", "bureau", "survey", "polytechnic"}
TITLES = frozenset("dr prof professor mr mrs ms sir dame phd md msc ba jr sr ii iii iv dipl ing".split())
PARTICLES = frozenset("van der den de del della di da dos du von zu la le al el bin ibn ter ten of the for and".split())
FILLERS = frozenset("the of for and in at".split())
CHANCE = 0.003

_VOWELS = str.maketrans("", "", "aeiou")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+|\d+")


class Name:
    __slots__ = ("tokens", "number", "organisation", "joined")

    def __init__(self, text: str):
        key = comparison_key(text).replace("'", "").replace("’", "")
        number = re.search(r"(?:^|\s)(\d{4})\s*$", key)
        self.number = number.group(1) if number else ""
        body = key[: number.start()] if number else key
        raw = _TOKEN.findall(body)
        spelled = [ORGANISATION_WORDS.get(t, t) for t in raw]
        self.organisation = not ORGANISATION_MARKS.isdisjoint(spelled) and len(spelled) > 2
        if self.organisation:
            self.tokens = tuple(t for t in spelled if t not in FILLERS)
        else:
            front, comma, back = body.partition(",")
            given = [t for t in _TOKEN.findall(back) if t not in TITLES]
            ordered = (given + _TOKEN.findall(front)) if comma and given else raw
            kept = [t for t in ordered if t not in TITLES] or ordered
            self.tokens = tuple(kept)
        self.joined = "".join(self.tokens)


@lru_cache(maxsize=200_000)
def parse(text: str) -> Name:
    return Name(text)


def is_full(token: str) -> bool:
    """Whether a token is spelled out and says something."""
    return len(token) > 1 and token not in PARTICLES


@lru_cache(maxsize=500_000)
def slips(a: str, b: str, most: int) -> int:
    """Edits between a and b, swapped neighbours counting one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    k, n = 0, min(len(a), len(b))
    while k < n and a[k] == b[k]:
        k += 1
    a, b, n = a[k:], b[k:], n - k
    k = 0
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    if k:
        a, b = a[:-k], b[:-k]
    if not a or not b:
        return max(len(a), len(b))
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return row[-1]


def edits(a: str, b: str) -> int:
    """Letters put in, left out or changed between a and b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@lru_cache(maxsize=100_000)
def formal(token: str) -> frozenset[str]:
    return frozenset(NICKNAMES.get(token, "").split())


@lru_cache(maxsize=500_000)
def letters(token: str) -> int:
    """A bit for each letter of the token, some letters sharing one; an edit changes two at most."""
    mask = 0
    for c in token:
        mask |= 1 << ord(c) % 61
    return mask


@lru_cache(maxsize=1_000_000)
def token_cost(a: str, b: str) -> float:
    """Cost of taking a and b for the same part of a name; 9 if they are not."""
    if a == b:
        return 0.0
    if a > b:
        a, b = b, a
    if len(a) == 1 or len(b) == 1:
        return 1.05 if a[0] == b[0] or any(f[0] in (a, b) for f in formal(a) | formal(b)) else 9.0
    if b in formal(a) or a in formal(b):
        return 0.5
    longest, shortest = max(len(a), len(b)), min(len(a), len(b))
    best = 9.0
    if shortest >= 3:
        allowed = 1 if longest <= 5 else 2
        d = slips(a, b, allowed) if longest - shortest <= allowed and (letters(a) ^ letters(b)).bit_count() <= 2 * allowed else allowed + 1
        if d <= allowed and (a[0] == b[0] or d == 1 and shortest > 3):  # a first letter tells short parts apart
            best = float(d)
    if best > 1 and shortest >= 3 and (b.startswith(a) or a.startswith(b)):
        best = 0.7 if shortest < longest - 1 else best
    if best > 2:
        if shortest >= 4 and a[0] == b[0] and a.translate(_VOWELS) == b.translate(_VOWELS):
            best = 1.5
        for nick, full in ((a, b), (b, a)):
            if 2 < len(nick) < 7 and any(full in formal(n) and slips(nick, n, 1) <= 1 for n in _like(nick)):
                best = min(best, 1.5)
    return best


@lru_cache(maxsize=100_000)
def _like(token: str) -> tuple[str, ...]:
    return tuple(n for n in NICKNAMES if len(n) > 2 and slips(token, n, 1) <= 1)


def token_forms(token: str) -> set[str]:
    """Forms of which two name tokens share one if token_cost takes them for the same, initials aside."""
    # Two slips count only behind an equal first letter.
    forms = {token} | less_letters(token, len(token) > 1) | ({token[0] + t for t in less_letters(token[1:], 2)} if len(token) > 5 else set())
    forms |= {f"^{token[:k]}" for k in range(3, len(token) + 1)}
    if len(token) > 3:
        forms.add(f"~{token[0]}{token.translate(_VOWELS)}")
    return forms | {f"={f}" for n in (token, *(_like(token) if 2 < len(token) < 7 else ())) for f in (n, *formal(n))}


def less_letters(token: str, most: int | None = None) -> set[str]:
    """The token with up to most letters left out; by default two, one if it has two to five: two share a form if they
    are within two slips, or one where neither has more than five letters."""
    out, last = set(), {token}
    for _ in range((2 if len(token) > 5 else len(token) > 1) if most is None else most):
        last = {t[:k] + t[k + 1 :] for t in last for k in range(len(t))}
        out |= last
    return out


def assign(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, int, list[int], list[int]]:
    """Cheapest one-to-one assignment of the tokens of a (no longer than b) to those of b.

    Gives its cost, how many full tokens met full tokens, the tokens of b left over and those that met full ones."""
    if len(b) > 9:
        return assign_long(a, b)
    states: dict[int, tuple[float, int, int]] = {0: (0.0, 0, 0)}
    for x in a:
        following: dict[int, tuple[float, int, int]] = {}
        for used, (cost, full, spelled) in states.items():
            for j, y in enumerate(b):
                if not used >> j & 1:
                    c = token_cost(x, y)
                    if c < 9:
                        both = is_full(x) and is_full(y)
                        option = (cost + c, full - both, spelled | both << j)
                        at = used | 1 << j
                        if at not in following or option < following[at]:
                            following[at] = option
        states = following
        if not states:
            return 9.0, 0, [], []
    used, (cost, full, spelled) = min(states.items(), key=lambda s: s[1])
    return cost, -full, [j for j in range(len(b)) if not used >> j & 1], [j for j in range(len(b)) if spelled >> j & 1]


def assign_long(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, int, list[int], list[int]]:
    """The same in polynomial time (Hungarian method), for names of many tokens."""
    never, n, m = 1e6, len(a), len(b)
    # Of equally cheap assignments the one with more full tokens counts.
    price = [[never if (c := token_cost(x, y)) >= 9 else c - 1e-6 * (is_full(x) and is_full(y)) for y in b] for x in a]
    u, v, taken, back = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        taken[0], j = i, 0
        least, done = [math.inf] * (m + 1), [False] * (m + 1)
        while taken[j]:
            done[j], row, step, to = True, taken[j], math.inf, 0
            for k in range(1, m + 1):
                if not done[k]:
                    if (c := price[row - 1][k - 1] - u[row] - v[k]) < least[k]:
                        least[k], back[k] = c, j
                    if least[k] < step:
                        step, to = least[k], k
            for k in range(m + 1):
                if done[k]:
                    u[taken[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = to
        while j:
            taken[j] = taken[back[j]]
            j = back[j]
    pairs = [(a[taken[j] - 1], b[j - 1], j - 1) for j in range(1, m + 1) if taken[j]]
    costs = [token_cost(x, y) for x, y, _ in pairs]
    if any(c >= 9 for c in costs):
        return 9.0, 0, [], []
    spelled = [j for x, y, j in pairs if is_full(x) and is_full(y)]
    return sum(costs), len(spelled), [j - 1 for j in range(1, m + 1) if not taken[j]], spelled


def ends(tokens: tuple[str, ...]) -> tuple[int, int]:
    """Places of the first and the last part, particles aside if two others are there."""
    said = [k for k, t in enumerate(tokens) if t not in PARTICLES]
    return (said[0], said[-1]) if len(said) > 1 else (0, len(tokens) - 1)


def joined_ends(name: Name) -> str:
    return name.joined[:3] + name.joined[-3:]


def compare(left: str, right: str) -> tuple[int, float] | None:
    """(grade, cost) if the names can be one entity's: grade 0 names both spelled out, 1 with initials only."""
    a, b = parse(left), parse(right)
    if a.number != b.number or a.organisation != b.organisation or not a.tokens or not b.tokens:
        return None
    if a.tokens == b.tokens:
        return (0 if sum(len(t) > 1 for t in a.tokens) > 1 or a.organisation else 1), 0.0
    if (len(a.tokens), a.tokens) > (len(b.tokens), b.tokens):
        a, b = b, a
    cost, full, left_over, spelled = assign(a.tokens, b.tokens)
    first, last = ends(b.tokens)
    if cost >= 9 or first not in spelled and last not in spelled:
        if len(a.joined) >= 8 and len(a.tokens) != len(b.tokens) and joined_ends(a) == joined_ends(b):
            d = slips(a.joined, b.joined, 2)
            if d <= 2 and edits(a.joined, b.joined) <= 2:
                return 0, d + 0.5
        return None
    if a.organisation:
        return (0, cost) if not left_over and cost <= 3 and len(b.tokens) > 1 else None
    spare = [j for j in left_over if b.tokens[j] not in PARTICLES]
    # Parts may be missing in the middle, never the first or the last one, and one of these is spelled out on both sides.
    if first in left_over or last in left_over or len(spare) > 2 or cost > 3.6:
        return None
    persons = [t for t in a.tokens if t not in PARTICLES]
    if len(persons) < 2:
        return None
    return (0 if full > 1 else 1), cost + 0.3 * len(spare) + 0.1 * (len(left_over) - len(spare))


def pairs_in_runs(sorted_values: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of equal values, up to about most at once."""
    n = len(sorted_values)
    start = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if n else np.zeros(0, np.int64)
    end = np.r_[start[1:], n].repeat(np.diff(np.r_[start, n])) if n else start
    behind = end - np.arange(n) - 1
    ends, at = np.cumsum(behind), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        many = behind[at:to]
        i = np.arange(at, to).repeat(many)
        yield i, i + 1 + np.arange(len(i)) - (np.cumsum(many) - many).repeat(many)
        at = to


def in_runs(rows: DataFrame, key: str, work, schema: str, chunk: int = 100_000) -> DataFrame:
    """What work gives for tables of all rows of some keys, in the order of the keys."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, most = [], 0, chunk
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= most:
                table = pa.Table.from_batches(held)
                at = table[key].to_numpy()
                last = int(np.searchsorted(at, at[-1]))
                if last:
                    yield work(table.slice(0, last))
                    held, count = table.slice(last).to_batches(), len(table) - last
                most = max(chunk, 2 * count)
        if count:
            yield work(pa.Table.from_batches(held))

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(walk, schema)


def spellings(tokens: DataFrame, forms, alike, hub: int = 16) -> DataFrame:
    """token, near, stand: of the tokens of tokens(token, n), the commoner ones it is filed under as well, if any.

    forms gives strings of which two tokens that are alike share one. Of two that are alike the commoner is near the
    other; but of two with less than hub occurrences a third may stand for both, the commonest that is like each of
    them. So a misspelling needs its word only and not all other misspellings of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(t, [*forms(t)]) for t in batch["token"].to_numpy(False)]
            form = np.fromiter((xxhash.xxh64_intdigest(f) - (1 << 63) for _, fs in told for f in fs), np.int64)
            asks = np.fromiter((f[:1] != "^" or f[1:] == t for t, fs in told for f in fs), bool)
            rows = batch.take(pa.array(np.arange(len(told)).repeat(np.array([len(fs) for _, fs in told], np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(form), pa.array(asks), *(rows[c] for c in ("token", "n", "top"))], ["form", "asks", "token", "n", "top"])

    def met(df: DataFrame, common: bool) -> DataFrame:
        """token, other, m: pairs that are alike, with the commoner as other, of tokens one of which is common or of rare ones of
        different top; a prefix that many tokens have brings only the one that is that prefix to them."""

        def meet(table: pa.Table) -> pa.RecordBatch:
            asks, n, token, top = (table[c].to_numpy() for c in ("asks", "n", "token", "top"))
            word, kind = pd.factorize(token)[0].astype(np.int64), pd.factorize(top)[0]
            row = np.zeros(len(word), np.int64)
            row[word] = np.arange(len(word))
            found = [np.zeros(0, np.int64)]
            for i, j in pairs_in_runs(table["form"].to_numpy()):
                keep = (word[i] != word[j]) & (((n[i] >= hub) | (n[j] >= hub)) & (asks[i] | asks[j]) if common else (asks[i] | asks[j]) & (kind[i] != kind[j]))
                i, j = word[i[keep]], word[j[keep]]
                found.append(np.unique(np.minimum(i, j) << 32 | np.maximum(i, j)))
            found = np.unique(np.concatenate(found))
            ends = (sorted(((int(n[x]), token[x]), (int(n[y]), token[y]))) for x, y in zip(row[found >> 32], row[found & 0xFFFFFFFF]))
            told = [(a, b, m) for (_, a), (m, b) in ends if alike(a, b)]
            return pa.RecordBatch.from_pydict(dict(zip(("token", "other", "m"), zip(*told) if told else ([], [], []))), pa.schema([("token", pa.string()), ("other", pa.string()), ("m", pa.int64())]))

        filed = df.select("token", "n", "top").repartition("token").mapInArrow(run, "form long, asks boolean, token string, n long, top string")
        return in_runs(filed, "form", meet, schema).distinct()

    schema = "token string, other string, m long"
    common = cut(met(tokens.withColumn("top", F.col("token")), True))
    tops = common.groupBy("token").agg(F.max(F.struct("m", "other")).alias("t")).select("token", F.col("t.other").alias("top"))
    rare = tokens.filter(F.col("n") < hub).join(tops, "token", "left").select("token", "n", F.coalesce("top", "token").alias("top"))
    rest = cut(met(rare, False).unionByName(common).distinct())
    top = rest.groupBy("token").agg(F.max(F.struct("m", "other")).alias("t")).select("token", F.col("t.other").alias("top"))
    theirs = rest.join(top, "token").join(top.select(F.col("token").alias("other"), F.col("top").alias("their")), "other", "left")
    kept = theirs.join(tokens.filter(F.col("n") < hub).select("token", F.lit(True).alias("rare")), "token", "left")
    kept = kept.filter(f"other = top OR rare IS NULL OR m >= {hub} OR coalesce(their, other) <> top")
    return kept.groupBy("token").agg(F.sort_array(F.collect_set("other")).alias("near"), F.max(F.when(F.col("rare"), F.col("top"))).alias("stand"))


def same_token(a: str, b: str) -> bool:
    return token_cost(a, b) < 9


def index_keys(name: Name, near: dict[str, list[str]]) -> list[tuple[str, bool, bool]]:
    """(key, short, held): two names that compare accepts share a key that one of them holds and under which one is short.

    near holds, for a token, the commoner ones it may be a spelling of. Two spelled-out tokens give a key
    together; a token and the initial of another give one, short where that other is but an initial. The longer
    name has its first and last parts matched, so it holds the keys of those two; the other has them among all of its own."""
    tokens = name.tokens
    spelled = [(t, *near.get(t, ())) for t in tokens]
    first, last = ends(tokens)
    out: dict[str, list[bool]] = {}

    def add(key: str, short: bool, held: bool) -> None:
        had = out.setdefault(key, [False, False])
        had[0] |= short
        had[1] |= held

    for i, t in enumerate(tokens):
        if not is_full(t):
            continue
        for j, u in enumerate(tokens):
            if j == i:
                continue
            held = {i, j} == {first, last}
            if len(u) > 1 and (i < j or not is_full(u)):
                for x in spelled[i]:
                    for y in spelled[j]:
                        add(f"{name.number}+{min(x, y)} {max(x, y)}", True, held)
            for letter in {u[0], *(f[0] for f in formal(u))}:
                for x in spelled[i]:
                    add(f"{name.number}.{x} {letter}", len(u) == 1, held)
    if tokens and (len(tokens) == 1 or not any(map(is_full, tokens))):  # these match only if they are equal
        add(f"{name.number}~{' '.join(tokens)}", True, True)
    if len(name.joined) >= 8:  # parts written together or apart
        add(f"{name.number}={joined_ends(name)}", True, True)
    return [(k, *v) for k, v in out.items()]


def name_counts(rows: DataFrame) -> DataFrame:
    """name, n rows, bare (those without pid) of each distinct name; partial sums first."""
    named = rows.filter("name_norm IS NOT NULL AND trim(name_norm) <> ''")
    return named.groupBy(F.col("name_norm").alias("name")).agg(F.count("*").alias("n"), F.sum(F.col("pid").isNull().cast("long")).alias("bare"))


def keyed_names(names: DataFrame) -> DataFrame:
    """name, loose, key, short, held, parts (its tokens), joined (of names whose ends are the key) of the names of names(name, loose)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(n, loose, list(set(parse(n).tokens))) for n, loose in zip(batch["name"], batch["loose"])], columns=["name", "loose", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, keys, parts, joined = [], [], [], []
            for n, told in zip(batch["name"].to_numpy(False), batch["told"].to_pylist()):
                name = parse(n)
                own = index_keys(name, {t["token"]: t["near"] for t in told})
                mark = f"{name.number}="
                many.append(len(own))
                keys += own
                parts += [len(name.tokens)] * len(own)
                joined += [name.joined if k.startswith(mark) else None for k, _, _ in own]
            rows = batch.take(pa.array(np.arange(len(many)).repeat(np.array(many, np.int64))))
            code = np.fromiter((xxhash.xxh64_intdigest(k) - (1 << 63) for k, _, _ in keys), np.int64)
            columns = [rows["name"], rows["loose"], pa.array(code), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.bool_()), pa.array(parts, pa.int32()), pa.array(joined, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "loose", "key", "short", "held", "parts", "joined"])

    parts = cut(names.select("name", "loose").mapInPandas(split, "name string, loose boolean, tokens array<string>"))
    each = parts.select("name", "loose", F.explode("tokens").alias("token"))
    near = spellings(each.filter(F.length("token") > 1).groupBy("token").agg(F.count("*").alias("n")), token_forms, same_token)
    told = each.join(near, "token", "left").groupBy("name", "loose").agg(F.collect_list(F.when(F.col("near").isNotNull(), F.struct("token", "near"))).alias("told"))
    return told.mapInArrow(run, "name string, loose boolean, key long, short boolean, held boolean, parts int, joined string")


def matched_pairs(names: DataFrame) -> DataFrame:
    """left (one of names(name, loose) that is loose), right, grade, cost: distinct pairs that compare accepts.

    Names that meet under a key are compared there, so what is shuffled are the keys of the names and the pairs accepted, not
    the far more pairs that meet."""

    def meet(table: pa.Table) -> pa.RecordBatch:
        name, loose, short, held, parts, joined = (table[c].to_numpy() for c in ("name", "loose", "short", "held", "parts", "joined"))
        number = pd.factorize(name)[0].astype(np.int64)
        apart = np.array([j is not None for j in joined], bool)
        length = np.array([len(j) if j is not None else 0 for j in joined], np.int64)
        mask = np.array([letters(j) if j is not None else 0 for j in joined], np.uint64)
        rows: dict[tuple[str, str], tuple[int, float] | None] = {}
        for i, j in pairs_in_runs(table["key"].to_numpy()):
            keep = (loose[i] | loose[j]) & (short[i] | short[j]) & (held[j] & (parts[i] <= parts[j]) | held[i] & (parts[i] >= parts[j])) & (number[i] != number[j])
            # Joined names can match only where one has more parts, within two edits, each of which changes two letters at most.
            keep &= ~apart[i] | (parts[i] != parts[j]) & (np.abs(length[i] - length[j]) <= 2) & (np.bitwise_count(mask[i] ^ mask[j]) <= 4)
            i, j = i[keep], j[keep]
            first = np.unique(np.minimum(number[i], number[j]) << 33 | np.maximum(number[i], number[j]) << 1 | apart[i], return_index=True)[1]
            for x, y in zip(i[first], j[first]):
                pair = (name[x], name[y]) if name[x] < name[y] else (name[y], name[x])
                if rows.get(pair) is None and (slips(joined[x], joined[y], 2) <= 2 if apart[x] else all_met(*pair)) and (m := compare(*pair)):
                    rows[pair] = (*m, loose[x], loose[y]) if pair[0] == name[x] else (*m, loose[y], loose[x])
        told = [(*p, g, c) for (a, b), (g, c, one, other) in rows.items() for p, asks in (((a, b), one), ((b, a), other)) if asks]
        return pa.RecordBatch.from_pydict(dict(zip(("left", "right", "grade", "cost"), zip(*told) if told else ([], [], [], []))), pa.schema([("left", pa.string()), ("right", pa.string()), ("grade", pa.int32()), ("cost", pa.float64())]))

    return in_runs(keyed_names(names), "key", meet, "left string, right string, grade int, cost double").distinct()


def all_met(left: str, right: str) -> bool:
    """Whether each token of the name of fewer tokens may be one of the other's, as every assignment wants."""
    a, b = parse(left).tokens, parse(right).tokens
    if len(a) > len(b):
        a, b = b, a
    return all(x in b or any(token_cost(x, y) < 9 for y in b) for x in a)


def candidate_pairs(names: DataFrame) -> DataFrame:
    """left, right of matched_pairs."""
    return matched_pairs(names).select("left", "right")


def verified_pairs(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(a, b, *m) for a, b in zip(batch["left"], batch["right"]) if (m := compare(a, b))]
            yield pd.DataFrame(found, columns=["left", "right", "grade", "cost"])

    return pairs.mapInPandas(run, "left string, right string, grade int, cost double")


def _join_best(open_names: DataFrame, edges: DataFrame, labels: DataFrame, margin: float) -> DataFrame:
    """name, label for the open names that fit one labelled entity strictly best."""
    fits = (
        edges.join(open_names.select(F.col("name").alias("left")), "left", "left_semi")
        .join(labels.select(F.col("name").alias("right"), "label"), "right")
        .groupBy("left", "label")
        .agg(F.min(F.struct("grade", "cost")).alias("fit"))
    )
    ranked = fits.withColumn("place", F.row_number().over(Window.partitionBy("left").orderBy("fit", "label")))
    top = ranked.filter("place <= 2").groupBy("left").agg(
        F.max(F.when(F.col("place") == 1, F.col("label"))).alias("label"),
        F.max(F.when(F.col("place") == 1, F.col("fit"))).alias("best"),
        F.max(F.when(F.col("place") == 2, F.col("fit"))).alias("next"),
    )
    clear = F.col("next").isNull() | (F.col("next.grade") > F.col("best.grade")) | (F.col("next.cost") - F.col("best.cost") >= margin)
    return top.filter(clear).select(F.col("left").alias("name"), "label")


def _stars(members: DataFrame, edges: DataFrame) -> DataFrame:
    """name, label: members gathered around the most frequent spelled-out name they match.

    A variant is made from the usual spelling, so it lies next to it; who that is, is followed to the end."""
    m = members.select("name", "n")
    inside = (
        edges.filter("grade = 0 AND cost <= 2.2")
        .join(m.select(F.col("name").alias("left")), "left", "left_semi")
        .join(m.select(F.col("name").alias("right"), F.col("n").alias("rn")), "right")
        .select(F.col("left").alias("name"), F.struct("rn", "right").alias("o"))
    )
    hub = m.select("name", F.struct(F.col("n").alias("rn"), F.col("name").alias("right")).alias("o")).unionByName(inside)
    hubs = hub.groupBy("name").agg(F.max("o").alias("o")).select("name", F.col("o.right").alias("label"))
    hubs = cut(hubs)
    while True:  # every step halves the way to the hub, which is more frequent than all on it
        up = hubs.select(F.col("name").alias("label"), F.col("label").alias("__up"))
        hubs = cut(hubs.join(up, "label").select("name", F.col("__up").alias("label"), (F.col("__up") != F.col("label")).alias("moved")))
        if hubs.filter("moved").isEmpty():
            return hubs.select("name", "label")


def entities(rows: DataFrame, margin: float = 0.3, chance: float = CHANCE) -> DataFrame:
    """name, entity over the distinct name_norm of rows(name_norm, pid); a name that several pids carry has a row for each."""
    rows = rows.select("name_norm", F.when(F.trim("pid") != "", F.col("pid")).alias("pid"))
    names = cut(name_counts(rows).withColumn("loose", F.col("bare") == F.col("n")))
    fixed = rows.filter("pid IS NOT NULL AND trim(name_norm) <> ''").select(F.col("name_norm").alias("name"), F.concat(F.lit("pid:"), F.col("pid")).alias("label")).distinct()
    fixed = cut(fixed)
    loose = names.filter("loose").select("name", "n")
    share = names.filter("NOT loose").agg(F.avg(F.col("bare") / F.col("n")).alias("s")).first()["s"] or 0.0
    edges = cut(matched_pairs(names))
    often = F.pow(F.lit(min(max(float(share), 0.01), 0.9)), F.col("n")) < chance
    # The same spelling but for its characters is the same entity however often it comes without id.
    same = cut(_join_best(loose.filter(often), edges.filter("grade = 0 AND cost < 0.05"), fixed, margin))
    fixed = fixed.unionByName(same)
    hubs = _stars(loose.filter(often).join(same, "name", "left_anti"), edges).withColumn("label", F.concat(F.lit("name:"), F.col("label")))
    # Spelled-out frequent names found their own entities; initials among them may join one.
    rare = loose.filter(~often)
    joined = cut(_join_best(rare, edges, fixed.unionByName(hubs), margin))
    rest = rare.join(joined, "name", "left_anti")
    last = _stars(rest, edges).withColumn("label", F.concat(F.lit("name:"), F.col("label")))
    labels = cut(fixed.unionByName(hubs).unionByName(joined).unionByName(last))
    # Entities of a single name, most of them initials, get a second chance against whole entities.
    found = labels.filter("label LIKE 'name:%'")
    single = found.groupBy("label").agg(F.count("*").alias("k"), F.min("name").alias("name")).filter("k = 1").select("name")
    late = _join_best(single, edges.filter("grade = 1 OR cost <= 1"), found.join(single, "name", "left_anti"), margin)
    final = labels.join(late.select("name", F.col("label").alias("__late")), "name", "left")
    return final.select("name", F.coalesce("__late", "label").alias("entity"))


def variant_pairs(rows: DataFrame) -> DataFrame:
    """name_a, name_b, name_a < name_b: every pair of spellings of one entity.

    The result is asked for pair by pair; an entity has as many spellings as people gave it."""
    e = cut(entities(rows))
    a = e.select("entity", F.col("name").alias("name_a"))
    b = e.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b").distinct()
