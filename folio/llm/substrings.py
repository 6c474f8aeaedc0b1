"""Substring deduplication by prefix-partitioned suffix trees.

A window is ``window`` consecutive words. Each window is looked up at one suffix, the one
that begins at its smallest ``prefix``-word run (by hash, leftmost among equals); equal
windows choose equal suffixes, so only these suffixes are partitioned. Prefixes that occur
once cannot repeat and go first. The suffixes of a prefix form a group; a group of up to
``large`` suffixes becomes a subtree built in one task; in a larger one the prefix is lengthened to
the whole window in one step, where the group of equal windows is the node and its size decides.

In a subtree, suffixes are sorted by the words that follow, the common lengths of
neighbours give its internal nodes, and the words before extend a node's members to the
left. A node of depth d whose members agree on l words to the left is a repeat of l + d
words: repeats of a window or more mark the words to remove.

Exact copies are counted first; only one of them enters the trees, and all of them are
removed whole if they have a window at all.

Defined results: a null or empty text has no words. Texts shorter than a window lose
nothing. Repeated rows are copies of each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import small, written
from folio.llm.simhash import groups

WINDOW, PREFIX, LARGE = 35, 8, 500
CACHE = 400_000
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Word -> 64-bit hash, computed once per distinct word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, from the words' hashes."""
    n = len(h) - k + 1
    acc = h[:n].copy()
    for j in range(1, k):
        acc = acc * _ODD + h[j : j + n]
    acc ^= acc >> np.uint64(32)
    acc *= _MIX
    return acc ^ (acc >> np.uint64(29))


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """For every stretch of so many values, the position of its smallest, leftmost among equals."""
    at, size = np.arange(len(x)), 1
    while size < width:
        s = min(size, width - size)
        right = x[s:] < x[:-s]
        at, x = np.where(right, at[s:], at[:-s]), np.where(right, x[s:], x[:-s])
        size += s
    return at


def suffixes(h: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """(prefix hash, position, first window, last window) of the suffixes that stand for a text's windows."""
    if len(h) < window:
        return (np.empty(0, np.int64),) * 4
    x = run_hashes(h, prefix)
    p = smallest(x, window - prefix + 1)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    last = np.append(first[1:], len(p)) - 1
    pos = p[first]
    return x[pos].view(np.int64), pos, first, last


def _pack(pos, first, last):
    """Position and, behind it, how far before it the last and the first window begin."""
    return pos.astype(np.int64) << 20 | (pos - last) << 10 | (pos - first)


def _unpack(at: int) -> tuple[int, int, int]:
    return at >> 20, at >> 10 & 1023, at & 1023


def common(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def repeats(members: list[tuple[list, list, int, int]], window: int) -> list[list[tuple[int, int]]]:
    """The subtree of suffixes (words from the prefix on, words before it reversed, least and most words before).

    Per member: ranges (least, most) of the words before the suffix at which a repeated window begins.
    """
    n = len(members)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def mark(i: int, depth: int, left: int) -> None:
        lo, hi = max(members[i][2], window - depth), min(members[i][3], left)
        if lo <= hi:
            out[i].append((lo, hi))

    if n == 2:
        depth, left = common(members[0][0], members[1][0]), common(members[0][1], members[1][1])
        mark(0, depth, left)
        mark(1, depth, left)
        return out
    order = sorted(range(n), key=lambda i: members[i][0])
    depth = [min(window, common(members[a][0], members[b][0])) for a, b in zip(order, order[1:])]  # noqa: B905
    for d in sorted(set(depth)):
        start = 0
        for k in range(n):
            if k < n - 1 and depth[k] >= d:
                continue
            if k > start:  # a node of depth d: order[start] to order[k]
                inside = sorted(order[start : k + 1], key=lambda i: members[i][1])
                near = [common(members[a][1], members[b][1]) for a, b in zip(inside, inside[1:])]  # noqa: B905
                for j, i in enumerate(inside):
                    mark(i, d, max(near[j - 1] if j else -1, near[j] if j < len(near) else -1))
            start = k + 1
    return out


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, id of the row's content, copies of its text, whether it is the first copy."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.md5(F.encode(body, "UTF-8")).alias("key"))
    copies = written(rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1"))
    out = rows.join(small(copies), "key", "left")
    return out.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("id"), F.coalesce("copies", F.lit(1)).alias("copies"), (F.col("copies").isNull() | F.col("doc_id").eqNullSafe(F.col("first"))).alias("is_first"))


def covered(texts: DataFrame, window: int = WINDOW, prefix: int = PREFIX, large: int = LARGE) -> DataFrame:
    """(id, ranges): word ranges (from, to) of every text, first copies only, that repeated windows cover."""

    def scan(batches):
        cache = WordHashes()
        for b in batches:
            found, ids = [], []
            for t, i in zip(b["text"], b["id"], strict=True):
                ws = words(t)
                if len(ws) >= window:
                    h, pos, first, last = suffixes(np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws)), window, prefix)
                    found.append((h, _pack(pos, first, last)))
                    ids.append(np.full(len(h), i, np.int64))
            if found:
                yield pd.DataFrame({"h": np.concatenate([x for x, _ in found]), "id": np.concatenate(ids), "at": np.concatenate([x for _, x in found])})

    firsts = texts.filter("is_first").select("id", "text")
    seen = written(firsts.mapInPandas(scan, "h long, id long, at long"))
    # Written, so that both sides of the join have exchanges of their own and a hot prefix can be split.
    often = written(seen.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    again = written(seen.join(often, "h").groupBy("id").agg(F.collect_list(F.struct("h", "at", (F.col("n") > large).alias("big"))).alias("suffixes")))

    def cut(batches):
        for b in batches:
            out = []
            for t, i, found in zip(b["text"], b["id"], b["suffixes"], strict=True):
                ws = words(t)
                for s in found:
                    pos, lo, hi = _unpack(int(s["at"]))
                    if not s["big"]:
                        out.append((s["h"], 0, False, i, s["at"], b" ".join(ws[pos - hi : pos - lo + window])))
                        continue
                    for w in range(pos - hi, pos - lo + 1):
                        d = xxhash.xxh3_128_digest(b" ".join(ws[w : w + window]))
                        out.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), True, i, w, b""))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["h", "h2", "big", "id", "at", "words"])
                    out = []
            yield pd.DataFrame(out, columns=["h", "h2", "big", "id", "at", "words"])

    pieces = written(firsts.join(again.hint("merge"), "id").select("id", "text", "suffixes").mapInPandas(cut, "h long, h2 long, big boolean, id long, at long, words binary"))

    def trees(batches):
        for rows, starts in groups(batches, ["h"]):
            out = []
            h_at = [*starts.tolist(), len(rows)]
            ids, ats, texts_ = rows["id"].tolist(), rows["at"].tolist(), rows["words"].tolist()
            for s, e in zip(h_at, h_at[1:]):  # noqa: B905
                by_prefix: dict[tuple, list] = {}
                for k in range(s, e):
                    pos, lo, hi = _unpack(ats[k])
                    ws = texts_[k].split(b" ")
                    by_prefix.setdefault(tuple(ws[hi : hi + prefix]), []).append((ids[k], pos, (ws[hi:], ws[hi - 1 :: -1] if hi else [], lo, hi)))
                for group in by_prefix.values():
                    if len(group) > 1:
                        for (i, pos, _), ranges in zip(group, repeats([m for *_, m in group], window), strict=True):
                            out.extend((i, pos - hi, pos - lo + window) for lo, hi in ranges)
            yield pd.DataFrame(out, columns=["id", "from", "to"])

    trees_in = pieces.filter("NOT big").select("h", "id", "at", "words").repartition("h").sortWithinPartitions("h")
    ranges = trees_in.mapInPandas(trees, "id long, from int, to int")
    whole = pieces.filter("big").select("h", "h2", "id", "at")
    nodes = written(whole.groupBy("h", "h2").agg(F.count("*").alias("n")).filter("n > 1"))
    ranges = ranges.union(whole.join(small(nodes), ["h", "h2"]).select("id", F.col("at").cast("int"), (F.col("at") + window).cast("int")))
    return ranges.distinct().groupBy("id").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("ranges"))


def kept(ws: list[bytes], ranges) -> list[bytes]:
    """The words that no range (sorted by start) covers."""
    out, at = [], 0
    for r in ranges:
        if r["from"] > at:
            out += ws[at : r["from"]]
        at = max(at, r["to"])
    return out + ws[at:]


def dedupe(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, large: int = LARGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    texts = _texts(docs, doc_id, text)
    ranges = written(covered(texts, window, prefix, large))

    def run(batches):
        for b in batches:
            out = []
            for d, t, copies, found in zip(b["doc_id"], b["text"], b["copies"], b["ranges"], strict=True):
                ws = words(t)
                left = [] if copies > 1 and len(ws) >= window else ws if found is None else kept(ws, found)
                out.append((d, len(ws), len(ws) - len(left), b" ".join(left).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"])

    rows = texts.join(ranges.hint("merge"), "id", "left").select("doc_id", "text", "copies", "ranges")
    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_removed long, kept string")

