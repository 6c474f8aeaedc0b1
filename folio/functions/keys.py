"""Keys under which spellings of one thing meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import text as T

TITLE_ID, PERSON_ID, ENTITY_ID = r"^tt[0-9]+$", r"^nm[0-9]+$", r"^Q[0-9]+$"


def despaced(normalized: Column) -> Column:
    return F.replace(normalized, F.lit(" "), F.lit(""))


def episode_title(title: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(title), "[^a-z0-9]+", "")


def title_keys(title: Column) -> Column:
    """The folded title, also without a number before it and a part after it; distinct, none empty."""
    bare = F.regexp_replace(title, r"^\s*(?:[Ee]pisode\s+)?[0-9]+\s*[:.\-]\s*", "")
    whole = F.regexp_replace(bare, r"(?i)[\s,:\-]*\(?(?:part|pt\.?)?\s*(?:[0-9]+|i{1,3}|iv|v)\)?\s*$", "")
    return F.filter(F.array_distinct(F.transform(F.array(title, bare, whole), episode_title)), lambda k: k != "")


def term_key(term: Column) -> Column:
    """White space folded, lower case."""
    return F.lower(F.trim(F.regexp_replace(term, r"\s+", " ")))


def service_key(name: Column, aliases: dict[str, str], suffixes: tuple[str, ...]) -> Column:
    """A service's name without what resellers append, under the name that its aliases lead to."""
    bare = F.regexp_replace(term_key(name), rf"\s+(?:{'|'.join(suffixes)})$", "")
    out = bare
    for alias, key in aliases.items():
        out = F.when(bare == alias, F.lit(key)).otherwise(out)
    return out


def person_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def language_code(tag: Column) -> Column:
    """The primary subtag of a language tag in lower case; null if it is none or undetermined."""
    head = F.lower(F.split_part(F.replace(F.trim(tag), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1)))
    return F.when(head.rlike("^[a-z]{2,3}$") & (head != "und"), head)


def plural(word: Column) -> Column:
    return F.when(word.endswith("y"), F.concat(F.regexp_replace(word, "y$", ""), F.lit("ies"))).otherwise(F.concat(word, F.lit("s")))


def stopword_only(text: Column) -> Column:
    """Whether a text has tokens and all are stopwords."""
    t = T.tokens(T.normalize(text))
    return (F.size(t) > 0) & F.forall(t, lambda x: x.isin(T.STOPWORDS))
