"""Text columns: normalisation, trigrams and similarities, all of them built-in functions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a decomposition, leading articles, stopwords.
SINGLE = {"ø": "o", "đ": "d", "ð": "d", "ł": "l"}
DOUBLE = {"æ": "ae", "ß": "ss", "œ": "oe", "þ": "th"}
ARTICLES = "the a an le la les el los las der die das den det en ett il lo gli de het".split()
STOPWORDS = "the a an of and in on to is it for at by der die das den dem ein eine le la les un une des du el los las una och en ett som pa av det il lo gli di da che".split()


@cache
def _folds() -> tuple[str, str]:
    """Characters whose decomposition is one ASCII letter or digit, then combining marks, and what they become."""
    plain = dict(SINGLE)
    for c in map(chr, range(0x80, 0xD800)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not "̀" <= x <= "ͯ").lower()
        if len(base) == 1 and base.isascii() and base.isalnum():
            plain[c] = base
    return "".join(plain) + "".join(map(chr, range(0x300, 0x370))), "".join(plain.values())


def normalize(text: Column) -> Column:
    """Lower-case ASCII words with one space between: accents go, ligatures are spelt out, all else is a space."""
    out = F.translate(F.lower(text), *map(str, _folds()))
    for a, b in DOUBLE.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(out)  # ASCII has nothing to fold
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def stripped(text: Column) -> Column:
    """Normalised, without one leading article."""
    return F.regexp_replace(normalize(text), f"^({'|'.join(ARTICLES)}) ", "")


def tokens(normalized: Column) -> Column:
    return F.array_remove(F.split(normalized, " "), "")


def trigrams(normalized: Column, padded: bool = True) -> Column:
    """Distinct trigrams; padded by a space on both sides, or as they stand."""
    s = F.concat(F.lit(" "), normalized, F.lit(" ")) if padded else normalized
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3)))
    return F.array_distinct(F.filter(grams, lambda g: F.length(g) == 3))


def similarity(query: Column, title: Column) -> Column:
    """0.65 · Jaccard + 0.35 · the share of the query's trigrams that the title has."""
    return overlap(trigrams(query), trigrams(title))


def overlap(q: Column, t: Column) -> Column:
    """The similarity of two texts by their distinct trigrams; these are best columns of their own, since each is used several times."""
    shared = F.size(F.array_intersect(q, t))
    every = F.size(F.array_union(q, t))
    return F.when((F.size(q) > 0) & (every > 0), 0.65 * shared / F.nullif(every, F.lit(0)) + 0.35 * shared / F.nullif(F.size(q), F.lit(0))).otherwise(0.0)


def coverage(query: Column, title: Column) -> Column:
    """Share of the query's tokens that the title contains, as substrings."""
    t = tokens(query)
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda x: F.contains(title, x))) / F.nullif(F.size(t), F.lit(0))).otherwise(0.0)


def capped_distance(a: Column, b: Column, cap: int = 3) -> Column:
    """Levenshtein distance; cap + 1 for all beyond the cap."""
    d = F.levenshtein(a, b, cap)
    return F.when(d < 0, cap + 1).otherwise(d)


def ids_in(text: Column) -> Column:
    """The ids of titles (tt) and people (nm) that a text names, in the order of their first mention; not those within a longer word."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?<![A-Za-z0-9])((?:tt|nm)[0-9]+)(?![A-Za-z0-9])"), F.lit(1)))
