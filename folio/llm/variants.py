"""Spelling variants by full neighbourhood generation.

Every string at one deletion, replacement or insertion from a word, over the letters that the vocabulary holds, is a
candidate; a candidate that is a word is a near word, and nothing needs its distance checked. A candidate is made once: a letter of a run of equal
letters is deleted only at the front of the run, a letter is not replaced by itself, and a letter is inserted only where the next one differs.

Words are numbers over their code points (a polynomial modulo 2^64), so a candidate's number follows from those of the word's
beginnings and ends in a few operations for all words of one length together. A bitmap of the vocabulary (``DENSITY`` bits a word, ``BITS``
bits at most; two places a word) tells which candidates may be words; only these become strings and are hash-joined to the vocabulary. The bitmap passes every
word, so nothing is lost; a vocabulary beyond its size makes more candidates travel and no other result.

A word's form is the near word of the largest count if that is ``TIMES`` times its own or more, so counts grow along forms and the way
to the last one is short; it is followed by doubling.

Occurrences change as the contract of the query says (one in ``EVERY`` runs loses a letter) only if asked with ``every``.

Defined results: a null or empty text has no words; a null doc_id is empty in the text that is hashed. Repeated rows count again. Of near words with
equal counts the first in code-point order is the form. Empty tables give empty results.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import written
from folio.llm.words import runs, slices

EVERY, LENGTH, LEAST, TIMES = 199, 6, 5, 5
#: Bits of the bitmap for each word, and the most it has (as a power of two).
DENSITY, BITS = 128, 28
#: Letters of words whose candidates are made at once; words of a task.
LETTERS, WORDS = 400_000, 10_000
#: Rounds of doubling; counts grow fivefold along forms, so that 64-bit counts allow 28 steps at most.
ROUNDS = 6

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
#: Odd factors; the upper bits of the product are a place in the bitmap.
_SPREAD = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def member(data: np.ndarray) -> np.ndarray:
    """A-Z, a-z, and U+00C0 to U+00FF: 0xC3 and the byte behind it."""
    mask = _LETTER[data]
    mask[1:] |= data[:-1] == 0xC3
    return mask


def occurrences(docs: DataFrame, every: int | None = None, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the runs of letters of at least ``length`` code points, in lower case, and how often they occur."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                row, found = runs(part.column("text"), member)
                long = pc.greater_equal(pc.binary_length(found), length)
                row, coded = row[long.to_numpy(zero_copy_only=False)], found.filter(long).dictionary_encode()
                names, code = coded.dictionary, coded.indices.to_numpy()
                if not len(names):
                    continue
                key, times = np.unique(row * len(names) + code, return_counts=True)
                doc, code = np.divmod(key, len(names))
                more: dict[str, int] = {}
                if every:
                    raw, starts = names.cast(pa.binary()).to_pylist(), [crc32(f"{i}:".encode()) for i in part.column("id").to_pylist()]
                    h = np.fromiter((crc32(raw[c], starts[d]) for c, d in zip(code.tolist(), doc.tolist(), strict=True)), np.int64, len(code))
                    hit = np.flatnonzero(h % every == 0)
                    for c, x, n in zip(code[hit].tolist(), h[hit].tolist(), times[hit].tolist(), strict=True):
                        word = raw[c].decode()
                        at = x % len(word)
                        word = word[:at] + word[at + 1 :]
                        more[word] = more.get(word, 0) + n
                    times[hit] = 0
                total = np.bincount(code, times, len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([names, pa.array(more, pa.string())]), pa.array(np.concatenate([total, np.fromiter(more.values(), np.int64, len(more))]))], names=["word", "n"])

    each = rows.mapInArrow(count, "word string, n long")
    return each.filter((F.col("n") > 0) & (F.length("word") >= length)).groupBy("word").agg(F.sum("n").alias("n"))


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])


def places(numbers: np.ndarray, factor: int, bits: int) -> np.ndarray:
    return (numbers * np.uint64(factor)) >> np.uint64(64 - bits)


def held(bitmap: np.ndarray, numbers: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the numbers that the bitmap passes."""
    own = np.arange(len(numbers))
    for factor in _SPREAD:
        at = places(numbers[own], factor, bits)
        own = own[(bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return own


def by_length(words: list[str], letters: int = LETTERS):
    """(indices, code points as rows of a matrix) of words of one length, in bounded parts."""
    order: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        order.setdefault(len(w), []).append(i)
    for size, own in order.items():
        step = max(1, letters // (size + 1))
        for a in range(0, len(own), step):
            part = own[a : a + step]
            yield np.array(part), np.array([words[i] for i in part], f"<U{size}").view(np.uint32).reshape(len(part), size)


def bitmap_of(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the words; tasks make blocks of 64 bits, which are put together by block."""

    def blocks(batches):
        for batch in batches:
            for _, points in by_length(batch.column("word").to_pylist()):
                numbers = (points.astype(np.uint64) * powers(points.shape[1])[:-1]).sum(1, dtype=np.uint64)
                at = np.unique(np.concatenate([places(numbers, f, bits) for f in _SPREAD]))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["block", "bit"])

    found = vocabulary.select("word").mapInArrow(blocks, "block long, bit long").groupBy("block").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(max(1, 2**bits // 64), np.uint64)
    out[found["block"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return out


def strings(points: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(points, np.uint32).view(f"<U{points.shape[1]}").ravel()


def neighbourhood(points: np.ndarray, alphabet: np.ndarray, bitmap: np.ndarray, bits: int):
    """(row, string) of the candidates of words of one length that may be words, letter by letter."""
    n, size = points.shape
    wide = points.astype(np.uint64)
    p = powers(size + 1)
    before = np.zeros((n, size + 1), np.uint64)
    np.cumsum(wide * p[:size], axis=1, out=before[:, 1:])
    total = before[:, -1:]
    after = total - before
    at = np.arange(size + 1)

    def passing(numbers: np.ndarray, wanted: np.ndarray):
        own = np.flatnonzero(wanted)
        own = own[held(bitmap, numbers.ravel()[own], bits)]
        return np.divmod(own, numbers.shape[1])

    first = np.ones((n, size), bool)
    first[:, 1:] = points[:, 1:] != points[:, :-1]
    row, i = passing(before[:, :-1] + after[:, 1:] * np.uint64(_BACK), first)
    if len(row) and size > 1:
        place = np.arange(size - 1)
        yield row, strings(points[row[:, None], place + (place >= i[:, None])])
    for a in alphabet:
        letter = np.uint64(a)
        row, i = passing(total + (letter - wide) * p[:size], points != a)
        if len(row):
            changed = points[row]
            changed[np.arange(len(row)), i] = a
            yield row, strings(changed)
        open_ = np.ones((n, size + 1), bool)
        open_[:, :-1] = points != a
        row, i = passing(before + letter * p[: size + 1] + after * np.uint64(_BASE), open_)
        if len(row):
            place = at[None, :]
            grown = points[row[:, None], np.clip(place - (place > i[:, None]), 0, size - 1)]
            grown[np.arange(len(row)), i] = a
            yield row, strings(grown)


def near(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): the pairs of (word, n) at one insertion, deletion or replacement, both ways."""
    spark = vocabulary.sparkSession
    size = vocabulary.count()
    alphabet = np.array(sorted(ord(r.c) for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()), np.uint32)
    bits = min(BITS, max(10, math.ceil(math.log2(max(1, size * DENSITY)))))
    shared = spark.sparkContext.broadcast((alphabet, bitmap_of(vocabulary, bits)))

    def candidates(batches):
        letters, bitmap = shared.value
        for batch in batches:
            words, n = batch.column("word"), batch.column("n")
            for own, points in by_length(words.to_pylist()):
                for row, found in neighbourhood(points, letters, bitmap, bits):
                    source = pa.array(own[row])
                    yield pa.RecordBatch.from_arrays([words.take(source), n.take(source), pa.array(found, pa.string())], names=["word", "n", "near"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / WORDS))
    made = vocabulary.repartition(parts, "word").mapInArrow(candidates, "word string, n long, near string")
    return made.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of the way along forms."""
    way = written(forms.select("word", F.col("form").alias("root")))
    for _ in range(ROUNDS):
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(way.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        way = longer.drop("moved")
        if not longer.filter("moved").limit(1).count():
            break
    return way


def group(docs: DataFrame, every: int | None = None, length: int = LENGTH, least: int = LEAST, times: int = TIMES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    vocabulary = written(occurrences(docs, every, length, doc_id, text).filter(F.col("n") >= least))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    found = near(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = written(found.select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n")))
    rows = vocabulary.join(found, "word", "left").withColumn("is_form", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False)))
    rows = written(rows.select("word", F.when(F.col("is_form"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("is_form"), F.col("best_n")).alias("form_n")))
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _nibble(x: int) -> int:
    for _ in range(4):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


_CRC = ", ".join(str(_nibble(x)) for x in range(16))
_LATIN = "".join(map(chr, range(0xC0, 0x100)))
#: One byte for each letter, as the SQL's distance counts bytes.
_BYTES = ("".join(map(chr, range(65, 91))) + "".join(c for c in map(chr, range(33, 65)) if c != "'") + "[]^_{}|~`\x7f\x01\x02\x03\x04\x05\x06")[: len(_LATIN)]
SQL = rf"""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS c, lower(hex(encode(doc_id::VARCHAR || ':' || w))) AS x FROM r WHERE length(w) >= {LENGTH} GROUP BY ALL),
h AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x)), lambda i: (instr('0123456789abcdef', x[xor(i, 1) + 1]) - 1)::BIGINT)),
  lambda a, b: xor(a >> 4, ([{_CRC}]::BIGINT[])[(xor(a, b) & 15) + 1])), 4294967295) AS h FROM g),
o AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n, translate(word, '{_LATIN}', '{_BYTES}') AS b FROM o WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(c) >= {LEAST}),
p AS (SELECT a.word, a.n, z.word AS near, z.n AS near_n FROM v a JOIN v z ON length(z.b) BETWEEN length(a.b) - 1 AND length(a.b) + 1 WHERE levenshtein(a.b, z.b) = 1),
f AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS best, max(near_n) AS best_n FROM p GROUP BY word),
t AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {TIMES} * v.n THEN best END AS form, CASE WHEN best_n >= {TIMES} * v.n THEN best_n END AS form_n FROM v LEFT JOIN f USING (word)),
w AS (WITH RECURSIVE k(word, spot, step) AS (SELECT word, word, 0 FROM t UNION ALL SELECT k.word, t.form, step + 1 FROM k JOIN t ON t.word = k.spot WHERE t.form IS NOT NULL)
  SELECT word, first(spot ORDER BY step DESC) AS root FROM k GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM t JOIN w USING (word)
"""
