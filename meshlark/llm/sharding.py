"""Balanced label propagation of documents to shards (after Ugander and Backstrom, 2013).

Documents of equal text are linked.  They start on hashed shards; in each round every
group that is spread prefers the shard where most of it is, among those with room,
and moves there within that shard's quota.  Documents without links give way: they
fill the shards up to counts that differ by one at most, which also settles what a quota
has left over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_rank, cut

SHARDS, ROUNDS = 24, 6
#: Rows that one window task ranks.
RANK_ROWS = 50_000


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _by_shard(df: DataFrame, shards: int, count: Column) -> list[int]:
    found = {r["shard"]: int(r["n"]) for r in df.groupBy("shard").agg(count.alias("n")).collect()}  # a row for each shard
    return [found.get(s, 0) for s in range(shards)]


def cut_links(linked: DataFrame) -> float:
    """Pairs of linked documents (g, shard) on different shards."""
    pairs = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    inside = linked.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n"))
    row = inside.groupBy("g").agg(F.sum("n").alias("m"), pairs("n").alias("kept")).agg((pairs("m") - F.sum("kept")).alias("x")).first()
    return row["x"] or 0.0


def within_quota(wishes: DataFrame, free: list[int], turn: int) -> DataFrame:
    """wishes (g, m, to): those that are granted, in the order of a hash, while their rows fit into the shard's free room.

    The running sum is taken within buckets of groups, on top of the sum of the buckets
    before, so no task meets all wishes for a shard.
    """
    n = wishes.count()
    luck = F.xxhash64("g", F.lit(-1 - turn))
    rows = wishes.withColumn("_luck", luck).withColumn("_bucket", F.pmod(luck, F.lit(max(1, -(-n // (len(free) * RANK_ROWS))))))
    sums = rows.groupBy("to", "_bucket").agg(F.sum("m").alias("_sum"))
    before = Window.partitionBy("to").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("to", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    upto = F.sum("m").over(Window.partitionBy("to", "_bucket").orderBy("_luck", "g").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto).join(sums, ["to", "_bucket"])
    return rows.where(F.col("_upto") + F.col("_before") <= _pick(free, F.col("to"))).select(*wishes.columns)


def propagate(linked: DataFrame, shards: int, room: int, rounds: int = ROUNDS) -> DataFrame:
    """linked (g, shard, ...): moves groups of one g onto one shard, so that no shard holds more than ``room`` rows of settled groups.

    Groups must be of ``room`` rows at most.  A group too large for all shards' free
    room, not granted its wish, or not reached in ``rounds``, stays spread.
    """
    for turn in range(rounds):
        pieces = linked.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n"))
        groups = pieces.groupBy("g").agg(F.collect_list(F.struct("n", "shard")).alias("parts"), F.sum("n").alias("m"))  # a group has at most ``shards`` parts
        groups = cut(groups.withColumn("spread", F.size("parts") > 1))
        settled = _by_shard(groups.where("not spread").select(F.col("parts")[0]["shard"].alias("shard"), "m"), shards, F.sum("m"))
        free = [max(0, room - n) for n in settled]
        best = F.array_max(
            F.transform(
                F.filter("parts", lambda p: _pick(free, p["shard"]) >= F.col("m")),
                lambda p: F.struct(p["n"].alias("n"), F.xxhash64("g", p["shard"], F.lit(turn)).alias("h"), p["shard"].alias("shard")),
            )
        )
        wishes = groups.where("spread").select("g", "m", best["shard"].alias("to")).where("to is not null")
        asked = _by_shard(wishes.select(F.col("to").alias("shard"), "m"), shards, F.sum("m"))
        if not any(asked):
            break
        moves = within_quota(wishes, free, turn).select("g", "to")
        linked = cut(linked.join(moves, "g", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"))
    return linked


def balance(rows: DataFrame, shards: int, n: int) -> DataFrame:
    """rows (shard, linked, prio, g, ...): moves just enough rows that shards' counts differ by one at most.

    Rows without links go first; of linked ones, whole groups follow each other.
    """
    counts = _by_shard(rows, shards, F.count(F.lit(1)))
    order = sorted(range(shards), key=lambda s: (-counts[s], s))
    goal = [n // shards] * shards
    for s in order[: n % shards]:
        goal[s] += 1
    surplus = [max(0, c - g) for c, g in zip(counts, goal, strict=True)]
    before = [sum(surplus[:s]) for s in range(shards)]
    ends = []
    for c, g in zip(counts, goal, strict=True):
        ends.append((ends[-1] if ends else 0) + max(0, g - c))
    if not ends[-1]:
        return rows
    buckets = max(1, -(-n // (shards * RANK_ROWS)))
    bucket = F.when(F.col("linked"), F.pmod(F.xxhash64("g"), F.lit(buckets)) + buckets).otherwise(F.pmod("prio", F.lit(buckets)))
    ranked = bounded_rank(rows, ["shard"], [F.col("linked"), F.col("g"), F.col("prio"), F.col("doc_id"), F.col("crc"), F.col("size")], bucket, "_at")
    mover = F.col("_at") < _pick(surplus, F.col("shard"))
    index = _pick(before, F.col("shard")) + F.col("_at")
    to = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= index))
    return ranked.withColumn("shard", F.when(mover, to).otherwise(F.col("shard")).cast("int")).drop("_at")


def assign_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row.

    The law is ``rows``: shards' counts differ by one at most.  Size is the text's UTF-8
    bytes (null: none) plus 8, the CRC that of those bytes.  Rows of equal text are
    linked (a null text to none), repeated rows among them; a group of more than half a
    shard is cut by hash into parts of about that size, which are then kept together.
    Slots count from 0 in each shard.  An empty table gives an empty one; other
    columns are ignored.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.when(text.isNotNull(), F.xxhash64(text, F.crc32(text.cast("binary")))).alias("g"),
    )
    prio = F.xxhash64(F.lit("shard"), "doc_id", "crc", "size")
    rows = cut(rows.withColumn("prio", prio).withColumn("shard", F.pmod("prio", F.lit(shards)).cast("int")))
    n = rows.count()
    room = max(1, n // shards)
    groups = cut(rows.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    parts = F.ceil(F.col("m") / max(1.0, room / 2))
    linked = rows.join(groups, "g").withColumn("g", F.when(parts > 1, F.xxhash64("g", F.pmod(F.xxhash64("prio", F.lit(1)), parts))).otherwise(F.col("g"))).drop("m")
    single = rows.join(groups, "g", "left_anti")
    linked = propagate(cut(linked), shards, room, rounds)
    every = linked.withColumn("linked", F.lit(True)).unionByName(single.withColumn("linked", F.lit(False)))
    every = cut(balance(cut(every), shards, n))
    buckets = max(1, -(-n // (shards * RANK_ROWS)))
    placed = bounded_rank(every, ["shard"], [F.col("doc_id"), F.col("crc"), F.col("size")], F.pmod("prio", F.lit(buckets)), "slot")
    return placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
