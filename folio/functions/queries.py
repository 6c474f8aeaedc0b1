"""What people type: quoted phrases, release noise, seasons, years and kinds, as columns over a log of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import keys as K
from folio.functions import text as T

# Quotes, release noise, type words, seasons, decades, years, words of recency and ranking, genres of lists.
QUOTE = "[\"“”„]"
NOISE = [
    r"1080p", r"720p", r"2160p", r"480p", r"4k", r"uhd", r"hdr", r"hdr10", r"dolby[ .]?vision", r"bluray", r"blu-ray", r"brrip", r"bdrip", r"webrip", r"web-?dl", r"hdtv",
    r"dvdrip", r"x264", r"x265", r"h ?264", r"h ?265", r"hevc", r"avc", r"aac\d?(?:\.\d)?", r"ac3", r"dts(?:-hd)?", r"truehd", r"atmos", r"ddp?\d(?:\.\d)?", r"remux",
    r"proper", r"repack", r"internal", r"limited", r"extended", r"unrated", r"imax", r"dual[ .]?audio", r"multi", r"subbed", r"dubbed", r"yify", r"yts", r"rarbg",
]
TYPES = [
    r"tv[ -]?series", r"tv[ -]?shows?", r"miniseries", r"mini[ -]?series", r"series", r"shows?", r"season", r"movies?", r"films?",
]
SEASON = r"(?i)\bs(?:eason)?[ .]?(\d{1,2})(?:[ .]?[ex](?:pisode)?[ .]?(\d{1,3}))?\b"
DECADE = r"(?i)\b((?:19|20)\d0)'?s\b"
YEAR = r"\(?\b(1[89]\d{2}|20\d{2})\b\)?"
RECENT = "new newest latest recent current".split()
BEST = "best top greatest finest good great".split()
GENRES = "Action Adventure Animation Comedy Crime Documentary Drama Fantasy Horror Mystery Sci-Fi Thriller".split()
GENRE_ALIASES = {"scifi": "Sci-Fi", "science fiction": "Sci-Fi"}
LANGUAGES = {"french": "fr", "german": "de", "spanish": "es", "italian": "it", "japanese": "ja", "korean": "ko"}

HOLE = ""
#: Longest query, most tokens, longest page, largest offset, longest list of ids.
LIMITS = {"chars": 200, "tokens": 32, "page": 200, "offset": 100_000, "ids": 200}


def _any(words: list[str]) -> str:
    return rf"(?i)\b(?:{'|'.join(words)})\b"


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _without_first(text: Column, found: Column) -> Column:
    """The text with a space in place of the first occurrence of what was found in it."""
    at = F.instr(text, found)
    return F.when((F.length(found) > 0) & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(found), F.length(text)))).otherwise(text)


def bounded(query: Column) -> Column:
    """At most so many characters and tokens of a query."""
    return F.array_join(F.slice(F.split(F.substring(query, 1, LIMITS["chars"]), " "), 1, LIMITS["tokens"]), " ")


def page(limit: int, offset: int) -> tuple[int, int]:
    """A page's size and offset within the limits; a negative one is an error."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return min(limit, LIMITS["page"]), min(offset, LIMITS["offset"])


def parse(rows: DataFrame, query: str, this_year: int) -> DataFrame:
    """Adds ``parsed``: struct(text, unquoted, phrases, stripped, year, decade, kind, season, episode, exact) of a query column.

    Closed quotes are lifted out first and put back last, so that nothing in them is taken for a signal. The last year
    from 1900 to three years ahead counts, and only if something else is left; a query that is all signals is its own text.
    A null query has a null text and no signals.
    """
    q, c = F.col("_q"), F.col
    own = rows.columns
    parts, inside = c("_parts"), lambda i: (i % 2 == 1) & (i < F.size("_parts") - 1)
    rows = rows.withColumn("_parts", F.split(F.concat(F.lit(" "), F.trim(F.coalesce(query, F.lit(""))), F.lit(" ")), QUOTE))
    rows = rows.withColumn("_phrases", F.filter(F.transform(parts, lambda s, i: F.when(inside(i), _folded(s)).otherwise("")), lambda s: s != ""))
    marked = F.transform(parts, lambda s, i: F.when(inside(i), F.when(_folded(s) == "", F.lit(" ")).otherwise(F.lit(f" {HOLE} "))).when(i % 2 == 1, F.concat(F.lit('"'), s)).otherwise(s))
    rows = rows.withColumn("_q", F.array_join(marked, "")).withColumn("_stripped", F.regexp_extract_all(q, F.lit(_any(NOISE)), F.lit(0)))
    rows = rows.withColumn("_q", F.regexp_replace(q, _any(NOISE), " "))
    for name, pattern in (("_season", SEASON), ("_decade", DECADE)):
        rows = rows.withColumn(name, F.array(*(F.regexp_extract(q, pattern, k) for k in range(3 if pattern is SEASON else 2)))).withColumn("_q", _without_first(q, c(name)[0]))
    years = F.filter(F.regexp_extract_all(q, F.lit(YEAR), F.lit(0)), lambda y: F.regexp_extract(y, r"\d+", 0).cast("int").between(1900, this_year + 3))
    rows = rows.withColumn("_last", F.coalesce(F.try_element_at(years, F.lit(-1)), F.lit(""))).withColumn("_rest", _without_first(q, c("_last")))
    rows = rows.withColumn("_dated", (c("_last") != "") & (_folded(c("_rest")) != "")).withColumn("_q", F.when(c("_dated"), c("_rest")).otherwise(q))
    rows = rows.withColumn("_types", F.transform(F.regexp_extract_all(q, F.lit(_any(TYPES)), F.lit(0)), F.lower)).withColumn("_q", F.regexp_replace(q, _any(TYPES), " "))
    number = lambda x: F.nullif(x, F.lit("")).cast("int")
    season = number(c("_season")[1])
    kind = F.when(F.exists("_types", lambda t: t.rlike("series|show|season")), "tvSeries").when(F.exists("_types", lambda t: t.rlike("movie|film")), "movie").when(season.isNotNull(), "tvSeries")
    whole = F.array_join(F.transform(F.split(q, HOLE), lambda s, i: F.concat(s, F.coalesce(F.get("_phrases", i), F.lit("")))), "")
    parsed = F.struct(
        F.coalesce(F.nullif(_folded(whole), F.lit("")), F.trim(query)).alias("text"), _folded(F.replace(q, F.lit(HOLE), F.lit(" "))).alias("unquoted"), c("_phrases").alias("phrases"),
        c("_stripped").alias("stripped"), F.when(c("_dated"), F.regexp_extract("_last", r"\d+", 0).cast("int")).alias("year"), number(c("_decade")[1]).alias("decade"),
        kind.alias("kind"), season.alias("season"), number(c("_season")[2]).alias("episode"), (F.size("_phrases") > 0).alias("exact"),
    )
    return rows.select(*own, F.explode(F.array(parsed)).alias("parsed"))  # filters on it stay above, where it is known


def year_score(year: Column, want: Column, decade: Column) -> Column:
    away = F.abs(year - want)
    near = F.when(away == 0, 9.0).when(away == 1, 6.0).when(away == 2, 3.0).when(away <= 5, 0.5).otherwise(-6.0)
    return (
        F.when(year.isNull(), F.when(want.isNotNull() | decade.isNotNull(), -4.0).otherwise(0.0)).when(want.isNotNull(), near)
        .when(decade.isNotNull(), F.when(year.between(decade, decade + 9), 6.0).otherwise(-5.0)).otherwise(0.0)
    )


def kind_score(kind: Column, want: Column) -> Column:
    same = F.when(want == "tvSeries", kind.isin("tvSeries", "tvMiniSeries")).otherwise(kind.isin("movie", "tvMovie"))
    return F.when(want.isNull(), 0.0).when(same, 4.0).otherwise(-5.0)


def recency_score(year: Column) -> Column:
    return F.when(year >= 2015, 1.2).when(year >= 2000, 0.4).otherwise(0.0)


def anticipation(year: Column, this_year: int) -> Column:
    """How much a title is looked forward to: 1 up to a year ahead, then half as much with every year of a bell; 0 beyond five."""
    away = year - this_year
    d = F.greatest(F.lit(0), F.abs(away) - F.when(away >= 0, 1).otherwise(0))
    return F.when(year.isNull() | (F.abs(away) > 5), 0.0).otherwise(F.pow(F.lit(2.0), -(d * d)))


def intent(rows: DataFrame, query: str, this_year: int) -> DataFrame:
    """Adds ``parsed`` and ``intent``: struct(genre, lang, kind, decade, year) of a query that asks for a shelf, else null.

    Every word must be a genre, a language, a word of recency or ranking or a stopword; two words are tried before one.
    """
    genre = {w: g for g in GENRES for w in (_plain(g), _plural(_plain(g)))} | GENRE_ALIASES
    shelf, known = list(genre) + list(LANGUAGES), list(genre) + list(LANGUAGES) + RECENT + BEST + list(T.STOPWORDS)
    own = rows.columns
    rows = parse(rows, query, this_year)
    joined = T.normalize(F.col("parsed.text"))
    for w in known:
        if " " in w:  # known pairs are joined first, so that one pass over the words is enough
            joined = F.regexp_replace(joined, rf"\b{w}\b", w.replace(" ", "_"))
    rows = rows.withColumn("_words", F.transform(T.tokens(joined), lambda t: F.replace(t, F.lit("_"), F.lit(" "))))
    p, words = F.col("parsed"), F.col("_words")
    has = lambda table: F.exists(words, lambda t: t.isin(list(table)))
    of = lambda table: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.get(F.filter(words, lambda t: t.isin(list(table))), F.lit(0))]
    decade = F.when(has(RECENT) & p["year"].isNull() & p["decade"].isNull(), F.lit(this_year // 10 * 10)).when(p["year"].isNull(), p["decade"])
    found = F.struct(of(genre).alias("genre"), of(LANGUAGES).alias("lang"), p["kind"].alias("kind"), decade.alias("decade"), p["year"].alias("year"))
    ok = F.forall(words, lambda t: t.isin(known)) & ~p["exact"] & has(shelf)
    return rows.select(*own, "parsed", F.explode(F.array(F.when(ok, found))).alias("intent"))


def _plain(word: str) -> str:
    return word.lower().replace("-", " ")


def _plural(word: str) -> str:
    return word[:-1] + "ies" if word.endswith("y") else word + "s"


def phonetic(word: Column) -> Column:
    """A key under which words of like sound meet: Soundex of the word without doubled letters."""
    return F.soundex(F.regexp_replace(word, r"(.)\1", "$1"))


stopword_only = K.stopword_only
