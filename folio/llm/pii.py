"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

Base spans are emails, ip addresses, card numbers and phone numbers. Information-theoretic
sanitisation adds terms: the words around a base span are its context, and over all
documents the pointwise mutual information of a context term with the protected value,
PMI(t; e) = log2(N n(t,e) / (n(t) n(e))), says how much of the value's information content
IC(e) = log2(N / n(e)) the term discloses. A term that co-occurs with the value in
``support`` documents or more and discloses ``disclose`` of its content or more is
generalised, one that discloses ``remove`` or more is removed: near the value and wherever else the term
stands in a document that holds the value.

Counts are of documents over the whole table. No text moves between tasks for them: only the
contexts of base spans are written, and the document frequency of terms is counted for the
terms that some pair needs. Texts are read again only where a term of theirs was found to disclose.

Defined results: a null text is empty and has no spans. Repeated rows have equal spans and
count as documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import BROADCAST_ROWS, free, fresh, small, written

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT, SUPPORT, DISCLOSE, REMOVE = 5, 3, 0.8, 0.95
#: Words whose folded form a task remembers.
CACHE = 100_000
STRIP = ".,;:!?*#%$&|\"'()[]{}<>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, so long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0") or "0") <= 3 and int(p) <= 255 for part in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def fold(word: str) -> str:
    return word.lower().strip(STRIP)


def words_apart(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, free) of every word; free if it touches no span."""
    covered: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    ends = [b for _, b in covered]
    out = []
    for m in _WORD.finditer(text):
        x, y = m.span()
        near = bisect_right(ends, x)  # the first that ends after x
        out.append((x, y, not (near < len(covered) and covered[near][0] < y)))
    return out


def contexts(text: str, spans: list[tuple[str, int, int]], width: int) -> list[tuple[str, str]]:
    """(entity, term) of the words within ``width`` words of a span that touch no span."""
    words = words_apart(text, spans)
    starts = [a for a, _, _ in words]
    out = set()
    for kind, a, b in spans:
        entity = f"{kind}:{fold(text[a:b])}"
        left, right = bisect_left(starts, a), bisect_left(starts, b)
        for x, y, free_ in words[max(0, left - width - 1) : right + width]:
            if free_ and (term := fold(text[x:y])):
                out.add((entity, term))
    return sorted(out)


def located(text: str, spans: list[tuple[str, int, int]], shares: dict[str, float]) -> list[tuple[int, int, float]]:
    """(start, end, share) of the words of the whole text that are such terms and touch no span."""
    return [(x, y, shares[t]) for x, y, free_ in words_apart(text, spans) if free_ and (t := fold(text[x:y])) in shares]


_FOUND = "key string, doc_id {id}, spans array<struct<kind:string,start:int,end:int>>, ctx array<struct<entity:string,term:string>>"


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.md5(F.encode(body, "UTF-8")).alias("key"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = CONTEXT) -> DataFrame:
    """Per row: key (of the text), doc_id, base spans and the terms around them; no text."""

    def run(batches):
        fresh()
        for batch in batches:
            spans = [base_spans(t) for t in batch["text"]]
            ctx = [contexts(t, s, width) if s else [] for t, s in zip(batch["text"], spans, strict=True)]
            yield pd.DataFrame({"key": batch["key"], "doc_id": batch["doc_id"], "spans": spans, "ctx": ctx})

    rows = _rows(docs, doc_id, text)
    return rows.mapInPandas(run, _FOUND.format(id=dict(rows.dtypes)["doc_id"]))


def _frequencies(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """(term, nt): documents with the term, for the terms given."""
    spark = docs.sparkSession
    wanted = None
    if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = spark.sparkContext.broadcast(frozenset(r.term for r in terms.collect()))

    def run(batches):
        folds: dict[str, str] = {}
        for batch in batches:
            seen: Counter = Counter()
            for t in batch["text"]:
                words = set(_WORD.findall(t))
                if len(folds) > CACHE:
                    folds.clear()
                for w in words.difference(folds):
                    folds[w] = fold(w)
                found = {folds[w] for w in words}
                seen.update(found & wanted.value if wanted else found)
            seen.pop("", None)
            yield pd.DataFrame({"term": list(seen), "n": list(seen.values())}, columns=["term", "n"]).astype({"term": str, "n": "int64"})

    if wanted is not None and not wanted.value:
        return spark.createDataFrame([], "term string, nt long")
    counts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("nt"))
    return counts.join(small(terms), "term")


def revealing(docs: DataFrame, found: DataFrame, text: str = "text", support: int = SUPPORT, disclose: float = DISCLOSE) -> DataFrame:
    """(entity, term, share): terms that disclose the share of the entity's information content."""
    total = found.count()
    pairs = written(found.select(F.explode(F.array_distinct(F.transform("ctx", lambda c: F.struct(c.entity, c.term)))).alias("p")).groupBy(F.col("p.entity"), F.col("p.term")).agg(F.count("*").alias("nte")).filter(F.col("nte") >= support))
    owned = found.select(F.explode(F.array_distinct(F.transform("ctx", lambda c: c.entity))).alias("entity")).groupBy("entity").agg(F.count("*").alias("ne"))
    freq = _frequencies(docs, pairs.select("term").distinct(), text)
    n = F.lit(float(total))
    pmi, ic = F.log2(n * F.col("nte") / (F.col("nt") * F.col("ne"))), F.log2(n / F.col("ne"))
    return pairs.join(owned, "entity").join(freq, "term").withColumn("share", F.when(ic > 0, pmi / ic).otherwise(0.0)).filter(F.col("share") >= disclose).select("entity", "term", "share")


def flags(found: DataFrame, flagged: DataFrame) -> DataFrame:
    """(key, flags: array of (term, share)): for each distinct text the terms that disclose a value it holds."""
    held = found.filter(F.size("ctx") > 0).select("key", F.explode(F.array_distinct(F.transform("ctx", lambda c: c.entity))).alias("entity")).distinct()
    hits = held.join(small(flagged), "entity").groupBy("key", "term").agg(F.max("share").alias("share"))
    return hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("term", "share"))).alias("flags"))


def term_spans(docs: DataFrame, marked: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, terms: array of (start, end, share)) of the distinct texts that hold flagged terms."""

    def run(batches):
        for batch in batches:
            found = [located(t, base_spans(t), {f["term"]: f["share"] for f in x}) for t, x in zip(batch["text"], batch["flags"], strict=True)]
            yield pd.DataFrame({"key": batch["key"], "terms": found})

    texts = _rows(docs, doc_id, text).select("key", "text").join(small(marked), "key")
    each = texts.mapInPandas(run, "key string, terms array<struct<start:int,end:int,share:double>>")
    return each.groupBy("key").agg(F.first("terms").alias("terms")).filter(F.size("terms") > 0)


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """Per row: key, doc_id, base spans and revealing terms."""
    found = written(find(docs, doc_id, text))
    marked = written(flags(found, written(revealing(docs, found, text, **bounds))))
    terms = written(term_spans(docs, marked, doc_id, text))
    return found.select("key", "doc_id", "spans").join(small(terms), "key", "left")


def _joined(spans, terms) -> str:
    return ",".join([f"{s['kind']}:{s['start']}:{s['end']}" for s in spans] + [f"term:{t['start']}:{t['end']}" for t in (terms if terms is not None else ())])


def digest(detected: DataFrame) -> DataFrame:
    """Per row: doc_id, counts by kind, base_sha256 and spans as text."""
    text = lambda kind, a, b: F.concat_ws(":", kind, a.cast("string"), b.cast("string"))
    base = F.transform("spans", lambda s: text(s.kind, s.start, s.end))
    more = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,share:double>>")), lambda t: text(F.lit("term"), t.start, t.end))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return detected.select(
        "doc_id", *(count(k) for k in KINDS[:4]), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, more), ",").alias("spans"), F.size(more).cast("long").alias("n_term"),
    )


def rewrite(text: str, spans: list[tuple[str, int, int, float]], remove: float) -> str:
    """Puts [KIND] for base spans, [TERM] or nothing for terms; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b, share in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out.append(text[at:a])
            out.append("" if kind == "term" and share >= remove else f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", remove: float = REMOVE, **bounds) -> DataFrame:
    """docs with the text sanitised; rows and other columns stay as they are."""
    found = written(find(docs, doc_id, text))
    marked = small(written(flags(found, written(revealing(docs, found, text, **bounds)))))
    key, own = free(docs, "_key"), free(docs, "_flags")
    keyed = docs.withColumn(key, F.md5(F.encode(F.col(text), "UTF-8"))).join(marked.withColumnsRenamed({"key": key, "flags": own}), key, "left").drop(key)

    def clean(t, flagged):
        if t is None:
            return None
        base = base_spans(t)
        spans = [(*s, 0.0) for s in base] + [("term", *x) for x in located(t, base, {f["term"]: f["share"] for f in flagged})] if flagged else [(*s, 0.0) for s in base]
        return rewrite(t, spans, remove) if spans else t

    def run(batches):
        fresh()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = [clean(t, flagged) for t, flagged in zip(batch.column(text).to_pylist(), batch.column(own).to_pylist(), strict=True)]
            yield batch.drop_columns([own]).set_column(at, text, pa.array(texts, pa.string()))

    return keyed.select(*(F.col(f"`{c}`") for c in docs.columns), own).mapInArrow(run, docs.schema)
