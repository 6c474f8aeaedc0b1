"""A written index of postings: built once, of which a batch of queries reads the buckets of its terms only.

Documents are numbered within parts: runs of at most ``PART`` of them, or about ``TEXT`` bytes, that a task inverts at once where it reads them. A row is a
block of at most ``BLOCK`` postings that a term has in a part, as numbers of documents and how often each holds the term (little-endian, as narrow as the part
allows); so rows are far fewer than postings, and only they are moved, to the bucket of their term. Bucket -1 has one row a part: the ids of its documents and their lengths.

A search takes the blocks of its terms to their parts and scores each part for itself, so that of each query only the best of a part move on. A block can
only matter if its largest share of a score, with the largest of all other terms of the query in the part, reaches the k-th best score that the task has seen; the others
are left out. Results are those of all postings.

Documents of the same id are scored as one; those that are also of the same length count as one document with the occurrences of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import plain
from folio.operators.search import B, K1, query_terms, top
from folio.session import few, saved

BUCKETS, PART, BLOCK = 64, 100_000, 128
#: Bytes of text that are inverted at once, documents whose blocks of a bucket a task writes, queries that are scored at once, and what rounding can add to a score, with a little more.
TEXT, WRITTEN, QUERIES, ROUNDED = 16_000_000, 1_000_000, 1_000, 1.01e-4


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Numbers as bytes, cut in rows; they are of one width."""
    kind = np.dtype("<u1" if values.max() < 1 << 8 else "<u2" if values.max() < 1 << 16 else "<u4")
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * kind.itemsize).astype(np.int32)), pa.py_buffer(values.astype(kind))])


def _unpacked(rows: pa.Array, n: int) -> np.ndarray:
    """The n numbers of all rows."""
    ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
    return np.frombuffer(rows.buffers()[2], f"<u{(ends[-1] - ends[0]) // n}", n, ends[0])


def _parts(batches: Iterator[pa.RecordBatch], most: int, repeated: bool) -> Iterator[pa.Table]:
    """Documents (id, text) in parts; repeated ones come in the order of their ids, which are not torn apart."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for piece in plain.pieces(batch, "text", TEXT, most):
            own = pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
            full = rows + piece.num_rows > most or size + own > TEXT
            if held and full and not (repeated and held[-1].column("id")[-1].as_py() == piece.column("id")[0].as_py()):
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
            held.append(piece)
            rows, size = rows + piece.num_rows, size + own
    if held:
        yield pa.Table.from_batches(held)


def _inverted(docs: pa.Table, part: int, block: int, repeated: bool) -> Iterator[pa.RecordBatch]:
    """The row of a part and those of its blocks."""
    docs = docs.combine_chunks()
    ids, texts = (docs.column(c).chunk(0) for c in ("id", "text"))
    lens, words = plain.words(texts)
    doc = np.repeat(np.arange(len(lens)), lens)
    lens[texts.is_null().to_numpy(zero_copy_only=False)] = -1  # has no length, but counts
    times = np.ones(len(lens), np.int64)
    if repeated:
        key = ids.dictionary_encode("encode").indices.to_numpy().astype(np.int64) * (lens.max() + 2) + lens + 1
        _, at, to, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        ids, lens, doc = ids.take(pa.array(at)), lens[at], to[doc]
    code = words.dictionary_encode()
    cells, tf = np.unique(code.indices.to_numpy().astype(np.int64) * len(lens) + doc, return_counts=True)
    term, at = np.divmod(cells, len(lens))
    first = np.flatnonzero(np.diff(term, prepend=-1))
    rank = np.arange(len(term)) - np.repeat(first, np.diff(first, append=len(term)))  # within its term
    starts = np.flatnonzero(rank % block == 0)
    cuts, n, none = np.append(starts, len(term)), len(starts), lambda k, kind: pa.nulls(k, kind)
    listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(lens)], pa.int32()), x)
    names, bytes_, ints = ["term", "part", "block", "n", "at", "tf", "ids", "lens", "times"], pa.binary(), pa.list_(pa.int32())
    own = [none(1, pa.string()), pa.array([part]), none(1, pa.int32()), pa.array([times.sum()], pa.int32()), none(1, bytes_), none(1, bytes_), listed(ids), *(listed(pa.array(x, pa.int32())) for x in (lens, times))]
    yield pa.RecordBatch.from_arrays(own, names=names)
    if n:
        blocks = [code.dictionary.take(pa.array(term[starts])), pa.array(np.full(n, part)), pa.array(rank[starts] // block, pa.int32()), pa.array(np.diff(cuts), pa.int32()), _packed(at, cuts), _packed(tf, cuts)]
        yield pa.RecordBatch.from_arrays([*blocks, none(n, pa.list_(ids.type)), none(n, ints), none(n, ints)], names=names)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows by lot and part."""
    held, last = [], None
    for batch in batches:
        lot, part = (batch.column(c).to_numpy() for c in ("lot", "part"))
        cuts = [0, *np.flatnonzero((np.diff(lot) != 0) | (np.diff(part) != 0)) + 1, len(part)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and last != (lot[a], part[a]):
                yield pa.Table.from_batches(held)
                held = []
            held, last = [*held, batch.slice(a, b - a)], (lot[a], part[a])
    if held:
        yield pa.Table.from_batches(held)


def _scored(batches: Iterator[pa.RecordBatch], k: int, mean: float) -> Iterator[pa.RecordBatch]:
    """(qid, id, score): the k best documents of each part for each query, as far as they can be among all that the task has seen."""
    best, lot = {}, None
    for rows in _runs(batches):
        if rows.num_rows < 2:
            continue  # no term is asked for
        if lot != rows.column("lot")[0].as_py():
            best, lot = {}, rows.column("lot")[0].as_py()
        head, rows = rows.slice(0, 1), rows.slice(1).combine_chunks()
        code = head.column("ids")[0].values.dictionary_encode("encode")
        ids, doc = code.dictionary, code.indices.to_numpy()
        units = int(np.bincount(doc).max())  # documents of one id
        norm = K1 * (1 - B + B * head.column("lens")[0].values.to_numpy() / mean)
        n = rows.column("n").to_numpy()
        at, tf = (_unpacked(rows.column(c).chunk(0), n.sum()) for c in ("at", "tf"))
        ends = np.cumsum(n)
        starts = ends - n
        share = np.repeat(rows.column("rarity").to_numpy(), n) * tf * (K1 + 1) / (tf + norm[at])
        at, most = doc[at], np.maximum.reduceat(share, starts)
        term = rows.column("term").chunk(0).dictionary_encode().indices.to_numpy()
        asked = rows.column("qids").chunk(0)
        owner = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
        asked = asked.flatten().dictionary_encode("encode")
        order = np.argsort(asked.indices.to_numpy(), kind="stable")
        own = np.split(owner[order], np.cumsum(np.bincount(asked.indices.to_numpy()))[:-1])
        found = []
        for q, (qid, blocks) in enumerate(zip(asked.dictionary.to_pylist(), own)):
            seen = best.get(qid, np.empty(0))
            bound = seen[0] - ROUNDED if len(seen) == k else 0.0
            new = np.flatnonzero(np.diff(term[blocks], prepend=-1))  # the blocks of a term stand together
            tops = np.maximum.reduceat(most[blocks], new)
            each = np.repeat(tops, np.diff(new, append=len(blocks)))
            blocks = blocks[most[blocks] + (units - 1) * each + units * (tops.sum() - each) >= bound]
            if not len(blocks):
                continue
            sums = np.bincount(np.concatenate([at[starts[b] : ends[b]] for b in blocks]), np.concatenate([share[starts[b] : ends[b]] for b in blocks]), len(ids))
            hits = np.flatnonzero((sums > 0) & (sums >= bound))
            if len(hits) > k:
                hits = hits[sums[hits] >= np.partition(sums[hits], -k)[-k] - ROUNDED]
            if len(hits) > k:  # of equal scores the first ids
                rounded = pa.table({"score": np.floor(sums[hits] * 1e4 + 0.5), "id": ids.take(pa.array(hits))})
                hits = hits[pc.sort_indices(rounded, sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_start").to_numpy()[:k]]
            best[qid] = np.sort(np.concatenate([seen, sums[hits]]))[-k:]
            found.append((np.full(len(hits), q), hits, sums[hits]))
        if found:
            q, hits, score = map(np.concatenate, zip(*found))
            yield pa.RecordBatch.from_arrays([asked.dictionary.take(pa.array(q)), ids.take(pa.array(hits)), pa.array(score)], names=["qid", "id", "score"])


class Postings:
    """The index under a path: ``postings`` (bucket, term, part, block, n, at, tf, ids, lens, times) and ``size`` (n, mean, buckets)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, docs: DataFrame, body: str = "text", buckets: int = BUCKETS, part: int = PART, block: int = BLOCK) -> Postings:
        """Writes the index of documents (id, body)."""
        docs = docs.select("id", F.col(body).alias("text"))
        kind = dict(docs.dtypes)["id"]

        def inverted(rows: DataFrame, repeated: bool) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                first = TaskContext.get().partitionId() << 32 | repeated << 31
                for number, found in enumerate(_parts(batches, part, repeated)):
                    yield from _inverted(found, first + number, block, repeated)

            return rows.mapInArrow(run, f"term string, part long, block int, n int, at binary, tf binary, ids array<{kind}>, lens array<int>, times array<int>")

        twice = saved(docs.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("_id")))
        if twice.limit(1).count():
            same = F.col("id").eqNullSafe(F.col("_id"))
            again = docs.join(few(twice), same, "left_semi").repartition("id").sortWithinPartitions("id", "text")
            rows = inverted(docs.join(few(twice), same, "left_anti"), False).union(inverted(again, True))
        else:
            rows = inverted(docs, False)
        bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int")
        tasks = -(-docs.count() // WRITTEN) or 1  # of one bucket; more documents, more tasks
        placed = rows.withColumn("bucket", bucket).repartition(F.when(F.col("term").isNull(), F.pmod(F.xxhash64("part"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket")), F.pmod(F.xxhash64("part"), F.lit(tasks)))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        written = self.spark.read.schema(placed.schema).parquet(f"{self.path}/postings")
        each = written.filter("bucket = -1").select(F.inline(F.arrays_zip("lens", "times")))
        held = F.col("lens") >= 0
        size = each.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"), (F.sum(F.when(held, F.col("lens").cast("long") * F.col("times"))) / F.sum(F.when(held, F.col("times")))).alias("mean"), F.lit(buckets).alias("buckets"))
        size.write.mode("overwrite").parquet(f"{self.path}/size")
        return self

    def _read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, score, place): the k best documents of each query (qid, query), by BM25."""
        size = self._read("size").first()
        if not size.mean:
            return queries.select("qid", F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("place")).limit(0)
        asked = saved(query_terms(queries).distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(size.buckets)).cast("int")))
        buckets = sorted(r.bucket for r in asked.select("bucket").distinct().collect())  # as many as buckets, at most
        lots = -(-asked.select("qid").distinct().count() // QUERIES) or 1
        rows = self._read("postings", buckets)
        df = rows.join(few(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("n").alias("df"))
        rarity = F.ln(1 + (F.lit(size.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        lot = F.pmod(F.xxhash64("qid"), F.lit(lots)).cast("int").alias("lot")
        wanted = saved(asked.join(df, ["bucket", "term"]).groupBy("bucket", "term", "df", lot).agg(F.collect_list(F.struct("qid")).alias("qids")).select("bucket", "term", "lot", rarity.alias("rarity"), F.col("qids.qid").alias("qids")))  # null is a qid too
        blocks = rows.drop("ids", "lens", "times").join(few(wanted), ["bucket", "term"])
        parts = self._read("postings", [-1]).select(F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), "part", "ids", "lens")
        met = blocks.unionByName(parts, allowMissingColumns=True).repartition("part").sortWithinPartitions("lot", "part", "term", "block")  # the part's own row has no term, so it is first
        kinds = dict(queries.dtypes)["qid"], dict(parts.dtypes)["ids"].removeprefix("array<").removesuffix(">")
        mean = size.mean
        found = met.mapInArrow(lambda batches: _scored(batches, k, mean), f"qid {kinds[0]}, id {kinds[1]}, score double")
        return top(found.select("qid", "id", F.round("score", 4).alias("score")), k, F.desc("score"))
