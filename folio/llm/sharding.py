"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards.

Documents of equal text are linked. Every round, each group's members see how many of their
neighbours are in each shard and ask to join the fullest; moves are granted within quotas:
as much from shard s to t as from t to s, and beyond that what t has room for. Documents
without links go last, as ballast that evens the sizes: large ones first, small ones fill.
DataFrame functions only; the driver sees no more than shards x shards sums.

Defined results: a null text has size 1 and its own crc of the empty text; it is equal to an
empty text. Repeated rows are documents of their own. An empty table gives an empty result.
A group larger than a shard is spread over as few shards as the quotas allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import running, written

BUCKETS, SALTS, HOT = 256, 32, 1000
#: Ballast below so many bytes is placed in the second pass.
SMALL_BYTES = 1024


def _bucket():
    """Places a group's rows side by side; the rows of large groups are spread over salts."""
    salt = F.when(F.col("n") > HOT, F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(F.lit(0))
    return F.pmod(F.col("g"), F.lit(BUCKETS)) * SALTS + salt


def _fill(pool: DataFrame, room: list[float], shards: int) -> DataFrame:
    """Gives the pool's rows to the shards, each a stretch as long as its room."""
    total, ends, at = sum(room), [], 0.0
    for r in room:
        at += r / total if total > 0 else 1 / shards
        ends.append(at)
    whole = pool.agg(F.sum("size").alias("s")).first().s or 0
    pool = running(pool, [], F.pmod(F.xxhash64("row"), F.lit(BUCKETS * 4)), [F.xxhash64("row"), F.col("row")], F.col("size"), "_at")
    middle, shard = F.col("_at") + F.col("size") / 2, F.lit(shards - 1)
    for k in reversed(range(shards - 1)):
        shard = F.when(middle < ends[k] * whole, F.lit(k)).otherwise(shard)
    return pool.withColumn("shard", shard.cast("int")).drop("_at")


def _loads(df: DataFrame, shards: int) -> list[float]:
    got = {r.shard: float(r.s) for r in df.groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    return [got.get(k, 0.0) for k in range(shards)]


def _quotas(want: dict[tuple[int, int], float], load: list[float], cap: float) -> dict[tuple[int, int], float]:
    """Bytes that may go from s to t: swaps first, then the room that is left in t, shared by demand."""
    grant = {(s, t): min(w, want.get((t, s), 0.0)) for (s, t), w in want.items()}
    for t in range(len(load)):
        asks = {s: want[s, t] - grant[s, t] for s in range(len(load)) if (s, t) in want}
        free, asked = max(0.0, cap - load[t]), sum(asks.values())
        for s, ask in asks.items():
            if asked > 0:
                grant[s, t] += min(ask, free * ask / asked)
    return grant


def _round(linked: DataFrame, load: list[float], cap: float) -> tuple[DataFrame, float]:
    """One round over the linked rows; also the bytes that asked to move."""
    shards = len(load)
    full = [k for k in range(shards) if load[k] >= cap]
    seats = linked.groupBy("g", "shard").agg(F.sum("size").alias("w"), F.count("*").alias("c"))
    # Written, so that the join has exchanges of its own and a hot group can be split.
    best = written(seats.groupBy("g").agg(F.max_by("shard", F.struct("c", "w", F.xxhash64("g", "shard"))).alias("to")))
    asked = linked.join(best, "g")
    want = {(r.shard, r.to): float(r.s) for r in asked.filter("to <> shard").groupBy("shard", "to").agg(F.sum("size").alias("s")).collect()}
    if not want or all(t in full for _, t in want) and not any((t, s) in want for s, t in want):
        return linked, 0.0
    grants = _quotas(want, load, cap)
    allowed = linked.sparkSession.createDataFrame([(s, t, g) for (s, t), g in grants.items()], "shard int, to int, quota double")
    movers = running(asked.filter("to <> shard"), ["shard", "to"], _bucket(), [F.col("g"), F.col("row")], F.col("size"), "_at")
    moved = movers.join(F.broadcast(allowed), ["shard", "to"], "left").withColumn("shard", F.when(F.col("_at") + F.col("size") <= F.col("quota"), F.col("to")).otherwise(F.col("shard")))
    stay = asked.filter("to = shard")
    cols = linked.columns
    return moved.select(cols).union(stay.select(cols)), sum(want.values())


def shard(docs: DataFrame, shards: int = 16, rounds: int = 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law (``bytes``), shard, slot (gapless in its shard), grown_shard (null)."""
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(body).cast("long") + 1
    rows = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body, F.md5(F.encode(body, "UTF-8"))).alias("g"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    counts = written(rows.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"))
    counted = rows.join(counts.hint("merge"), "g", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rows = written(counted.withColumn("shard", F.when(F.col("n") > 1, F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int"))))
    total = rows.agg(F.sum("size").alias("s")).first().s or 0
    cap = total / shards
    linked, single = rows.filter("n > 1"), rows.filter("n = 1")
    for _ in range(rounds):
        linked, asked = _round(linked, _loads(linked, shards), cap)
        if not asked:
            break
        linked = written(linked)
    # What a shard holds beyond its even part joins the ballast.
    linked = running(linked, ["shard"], _bucket(), [F.col("g"), F.col("row")], F.col("size"), "_at")
    over = F.col("_at") + F.col("size") > cap
    placed = written(linked.withColumn("shard", F.when(~over, F.col("shard"))).drop("_at"))
    ballast = single.select(placed.columns).union(placed.filter("shard IS NULL"))
    out = placed.filter("shard IS NOT NULL")
    for piece in (ballast.filter(F.col("size") >= SMALL_BYTES), ballast.filter(F.col("size") < SMALL_BYTES)):
        room = [max(0.0, cap - x) for x in _loads(out, shards)]
        out = written(out.union(_fill(piece, room, shards).select(out.columns)))
    slots = running(out, ["shard"], F.pmod(F.xxhash64("row"), F.lit(BUCKETS * 2)), [F.col("doc_id"), F.col("row")], F.lit(1), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
