"""Posts that are repeated keywords, links or product tags instead of sentences.

Per post, six features of its own text (quotes and signature taken off):
density of links and of tags, share of function words, entropy of the words,
their repetition, and the share of it that is no sentence. Per language, location
and scale are medians and median deviations over all posts, and the shape is
the correlation of winsorised scores, so spam does not move its own yardstick.
A post is flagged if its robust Mahalanobis distance is an outlier's and its
deviation points in a spam-directed direction: few function words and hardly a
sentence, together with dense links, dense tags, or few words over and over.

The per-language statistics are aggregates in the JVM (six numbers and a 6x6
matrix a language); only they reach the driver. Languages outside the known
ones, and null, share one group, whose statistics are those of all posts.

Defined results: null, empty and blank posts and posts of only quotes are not
spam; posts of any length are measured whole, short ones with scores that lean
towards what is typical; repeated posts are each reported; text in
a language without function words listed falls under the shared group.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.llm.skeleton import comparison_key
from bibspark.runtime import cut

# Frequent function words of the languages met, without accents.
FUNCTION_WORDS = {
    "en": "the a an of to in and or is are was were be been it its that this i you he she we they my your for on with as at by from not but if so do does did have has had no can will would what which who when where how there than then",
    "de": "der die das ein eine einen und oder ist sind war ich du er sie es wir ihr nicht mit von zu im am auf fur den dem des bei hat habe haben seit noch schon nur auch aber wenn wie was jemand mich dir wieder zuerst bevor nach uber",
    "fr": "le la les un une des de du et ou est sont je tu il elle nous vous ne pas ce cette que qui dans en sur pour par avec au aux mon ma mes a ai deja tres bien meme apres depuis sans",
    "es": "el la los las un una de del y o es son yo tu no que en con por para se su mi me lo al como mas muy antes pero ya si hay este esta",
}
_ALL_WORDS = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws.split())
LANGUAGES = tuple(FUNCTION_WORDS)
FEATURES = ("links", "tags", "sparse", "evenness", "repeats", "unsaid")
# Smallest scale a feature may have: where most posts agree exactly, median deviations vanish.
FLOORS = {"links": 0.02, "tags": 0.02, "sparse": 0.05, "evenness": 0.03, "repeats": 0.05, "unsaid": 0.1}
# Words and posts that what is typical counts for: a short post's scores and a small language's yardstick lean towards it.
TYPICAL_WORDS = 8
TYPICAL_POSTS = 50

_QUOTED_LINE = re.compile(r"^[ \t]*(?:>|&gt;|\||»)")
_HEADLINE = re.compile(r"(?i)^\s*(?:on\b.{0,80}\b(?:said|wrote)\s*:|quoting\s+\S+.{0,20}|\S+\s+(?:wrote|said|schrieb|escribio|escribió|a écrit)\s*:)\s*$")
_OPEN = re.compile(r"\[quote\b[^\]]*\]|<blockquote\b[^>]*>", re.I)
_CLOSE = re.compile(r"\[/quote\]|</blockquote>", re.I)
_EITHER = re.compile(r"(\[quote\b[^\]]*\]|<blockquote\b[^>]*>)|(\[/quote\]|</blockquote>)", re.I)
_SIGNATURE = re.compile(r"^(?:--+|__+|==+|~~+|\*\*\*+)\s*$|^\s*(?:sent from my|get .{1,30} for)\b.*$|^~\*~.*$|^-=.*=-.*$", re.I)
_URL = re.compile(r"(?i)(?:https?|ftp)://[^\s\"'<>\[\]()]+|www\.[^\s\"'<>\[\]()]+")
_HREF = re.compile(r"(?is)<a\b[^>]*>|\[url\b[^\]]*\]")
_TAG = re.compile(r"(?is)</?[a-z][^<>]*>|\[/?[a-z*][^\[\]]*\]")
_HASHTAG = re.compile(r"(?:^|(?<=[\s,;]))#\w+")
_STRETCH = re.compile(r"([^.!?|#\n]+)([.!?]*)")
_BEGIN = regex.compile(r"[\p{Lu}¿¡]")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}]+)?")
_ASCII_WORD = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)?")
_MACHINE = re.compile(r"\d{1,2}:\d{2}:\d{2}|\w+\[\d+\]|^\s*(?:for|if|elif|else|def|return|raise|import|while|try|except|class|select|public|static|int|var|let|const)\b.*[:;{()]\s*|[;{}]\s*$|[!=]=|->|\w\(\)|^\s*(?:at|File) \S+[(:]", re.I)


def own_text(text: str) -> str:
    """What the author of a post wrote: neither quoted lines and blocks nor the signature."""
    depth, start, kept = 0, 0, []
    for mark in _EITHER.finditer(text):
        if mark.group(1):
            if depth == 0:
                kept.append(text[start : mark.start()])
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                start = mark.end()
    if depth == 0:
        kept.append(text[start:])
    else:  # a block never closed: its first line break ends what it quotes
        last = list(_OPEN.finditer(text))[-1]
        kept.append(text[text.find("\n", last.end()) + 1 :] if "\n" in text[last.end() :] else "")
    lines = [x for x in "\n".join(kept).splitlines() if not _QUOTED_LINE.match(x) and not _HEADLINE.match(x)]
    for k, line in enumerate(lines):
        if _SIGNATURE.match(line) and sum(1 for x in lines[k + 1 :] if x.strip()) <= 5:
            if any(x.strip() for x in lines[:k]):
                return "\n".join(lines[:k])
    return "\n".join(lines)


def words_of(text: str) -> list[str]:
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def sentences(text: str) -> Iterator[str]:
    """Stretches from a capital letter to a full stop, of any length from ten characters, each read once."""
    for m in _STRETCH.finditer(text):
        if m.group(2) and (m.end() == len(text) or text[m.end()] in " \t\r\n\f\v\u00a0\"')*]<") and (b := _BEGIN.search(m.group(1))):
            if len(m.group(1)) - b.start() > 8:
                yield m.group(1)[b.start() :]


def features(text: str | None) -> tuple[float, ...] | None:
    """How many words the post's own text has, a link counting as three, and values in the order of FEATURES; None without own text."""
    if not text or not text.strip():
        return None
    own = html.unescape(own_text(text))
    if not own.strip():
        return None
    urls, anchors = _URL.findall(own), _HREF.findall(own)
    hashtags = _HASHTAG.findall(own)
    bare = _TAG.sub(" ", _URL.sub(" ", _HREF.sub(" ", own)))
    words = words_of(comparison_key(_HASHTAG.sub(lambda m: " " + m.group().strip("#"), bare) if hashtags else bare))
    slugs = words_of(" ".join(u.lower() for u in urls))
    spoken = [w for w in words if len(w) > 1 or w in _ALL_WORDS]
    total = len(spoken) + len(urls)
    if not total:
        return None
    links = len(urls) / max(1, total)
    tags = len(hashtags) / max(1, total)
    content = [w for w in spoken if w not in _ALL_WORDS]
    # Lines of a log or of code lack function words too, but no keyword is what they are about.
    filled = [x for x in own.splitlines() if x.strip()]
    machine = sum(1 for x in filled if _MACHINE.search(x) and not _HREF.search(x)) / len(filled)
    weight = 2 * len(urls)  # a link takes the room of some words
    sparse = (1 - (len(spoken) - len(content)) / (len(spoken) + weight) if spoken else 1.0) * (1 - machine)
    basis = content or slugs
    counts = Counter(basis)
    n = sum(counts.values())
    entropy = -sum(c / n * math.log(c / n) for c in counts.values()) if n else 0.0
    evenness = 1 - (entropy / math.log(n) if n > 1 else 1.0)
    repeats = sum(c for c in counts.values() if c > 2) / n if n else 0.0
    prose = sum(len(x) for x in map(words_of, map(comparison_key, sentences(bare))) if not _ALL_WORDS.isdisjoint(x))
    unsaid = 1 - min(1.0, prose / (len(words) + weight)) if spoken else 1.0
    return len(spoken) + 3 * len(urls), links, tags, sparse, evenness, repeats, unsaid


def language(lang: Column) -> Column:
    """The known language a label means, whatever its case or region; null for others."""
    short = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(short.isin(*LANGUAGES) & F.trim(lang).rlike(r"^[A-Za-z]{2}([-_].*)?$"), short)


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, language, words and one double per feature for every post with own text."""
    schema = "doc_id long, language string, words double, " + ", ".join(f"{f} double" for f in FEATURES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, g, *v) for d, g, t in zip(batch["doc_id"], batch["language"], batch["text"]) if (v := features(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "language", "words", *FEATURES])

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), language(F.col("lang")).alias("language"), F.col("text").cast("string").alias("text"))
    return slim.filter(F.trim("text") != "").mapInPandas(run, schema)


class Yardstick:
    """Location, scale and inverse correlation of one language's posts."""

    def __init__(self, centre: list[float], scale: list[float], shape: np.ndarray, ridge: float = 0.15):
        self.centre, self.scale = centre, scale
        k = len(centre)
        shape = np.nan_to_num(np.asarray(shape, float).reshape(k, k))
        spread = np.sqrt(np.clip(np.diag(shape), 1e-6, None))
        corr = shape / np.outer(spread, spread)
        np.fill_diagonal(corr, 1.0)
        self.inverse = np.linalg.inv((1 - ridge) * corr + ridge * np.eye(k))


def _scores(name: str, at: str = "") -> Column:
    return (F.col(name) - F.col(f"{at}c_{name}")) / F.col(f"{at}s_{name}")


def yardsticks(posts: DataFrame, winsor: float = 3.0, typical: int = TYPICAL_POSTS) -> dict[str | None, Yardstick]:
    """One yardstick per language, in which all posts together count as typical more, and one (key None) of all posts."""
    both = posts.select(F.explode(F.array_distinct(F.array(F.col("language"), F.lit(None).cast("string")))).alias("g"), *FEATURES)
    centre = both.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(f, 0.5, 2000).alias(f"c_{f}") for f in FEATURES])
    rows = {r["g"]: r for r in centre.collect()}  # a row per language
    if not rows:
        return {}
    share = {g: r["n"] / (r["n"] + typical) if g else 1.0 for g, r in rows.items()}
    lean = lambda g, own, of_all: share[g] * own + (1 - share[g]) * of_all
    centres = {g: {f"c_{f}": lean(g, r[f"c_{f}"], rows[None][f"c_{f}"]) for f in FEATURES} for g, r in rows.items()}
    spark = posts.sparkSession
    fields = ", ".join(f"c_{f} double" for f in FEATURES)
    mid = spark.createDataFrame([(g, *[r[f"c_{f}"] for f in FEATURES]) for g, r in centres.items()], f"g string, {fields}")
    off = both.join(F.broadcast(mid), both["g"].eqNullSafe(mid["g"])).select(mid["g"], *[F.col(f) - F.col(f"c_{f}") for f in FEATURES])
    off = off.toDF("g", *FEATURES)
    scale = off.groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(f)), 0.5, 2000).alias(f) for f in FEATURES]).collect()
    spread = {r["g"]: [max(1.4826 * r[f], FLOORS[f]) for f in FEATURES] for r in scale}
    scales = {g: [lean(g, x, y) for x, y in zip(v, spread[None])] for g, v in spread.items()}
    sized = spark.createDataFrame([(g, *v) for g, v in scales.items()], "h string, " + ", ".join(f"s_{f} double" for f in FEATURES))
    z = off.join(F.broadcast(sized), off["g"].eqNullSafe(sized["h"])).select(
        "g", *[F.greatest(F.lit(-winsor), F.least(F.lit(winsor), F.col(f) / F.col(f"s_{f}"))).alias(f) for f in FEATURES]
    )
    shape = z.groupBy("g").agg(*[F.avg(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a in FEATURES for b in FEATURES]).collect()
    shapes = {r["g"]: np.array([r[f"{a}__{b}"] for a in FEATURES for b in FEATURES]) for r in shape}
    return {g: Yardstick([centres[g][f"c_{f}"] for f in FEATURES], scales[g], lean(g, m, shapes[None])) for g, m in shapes.items()}


def spam_posts(documents: DataFrame, cut_distance: float = 6.0, sparse_cut: float = 2.5, unsaid_cut: float = 3.5, direction_cut: float = 3.0) -> DataFrame:
    """doc_id, distance and kind (links, tags or keywords) of the posts flagged."""
    posts = cut(measured(documents))  # read several times below; the texts are not
    sticks = yardsticks(posts)
    schema = "doc_id long, distance double, kind string"
    if not sticks:
        return posts.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g, part in batch.groupby(batch["language"].where(batch["language"].isin([k for k in sticks if k]), None).fillna("")):
                stick = sticks.get(g or None) or sticks[None]
                z = (part[list(FEATURES)].to_numpy() - stick.centre) / stick.scale
                words_in = part["words"].to_numpy()
                z *= (words_in / (words_in + TYPICAL_WORDS))[:, None]
                distance = np.sqrt(np.einsum("ij,jk,ik->i", z, stick.inverse, z).clip(0))
                link, tag, sparse, even, again = z[:, 0], z[:, 1], z[:, 2], z[:, 3], z[:, 4]
                words = np.minimum(even, again) + np.maximum(0, sparse - sparse_cut)
                most = np.argmax(np.stack([link, tag, words]), axis=0)
                hit = (distance > cut_distance) & (sparse > sparse_cut) & (z[:, 5] > unsaid_cut) & (np.maximum.reduce([link, tag, words]) > direction_cut)
                out.append(pd.DataFrame({"doc_id": part["doc_id"], "distance": distance, "kind": np.array(["links", "tags", "keywords"])[most]})[hit])
            yield pd.concat(out) if out else pd.DataFrame({"doc_id": [], "distance": [], "kind": []})

    return posts.mapInPandas(run, schema)
