"""Sharding by balanced label propagation.

Documents are linked through a group key (by default equal texts). Every linked document starts in
a shard of an even deal; in each round a group picks as home the shard in which most of it can meet,
later that which holds most of it (of several such, another in each round), and the group's other
documents ask to move there. Moves are admitted into the room that a shard's quota of rows leaves, and along cycles of requests, in which each
shard gives as many as it takes. The rounds end when IDLE_ROUNDS in turn admit nothing. Unlinked documents then fill every shard
to its quota, so that shard sizes in rows differ by one at most. A group of more rows than a shard
holds takes as many homes as it needs.

Defined results: a null text counts as empty (size 16, crc32 0, one group with empty texts); null
doc_ids and repeated rows are kept, each with its own slot; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.common import global_rank, heavy_join, materialize

SHARDS = 40
#: Bytes that each document counts beside its text.
OVERHEAD = 16
#: Rounds that admit nothing, each with other homes among equals, after which groups stay as they are.
IDLE_ROUNDS = 3
#: Rounds at most that choose homes by free room and move into it; those after them exchange rows too.
ROOM_ROUNDS = 12


def quotas(rows: int, shards: int) -> list[int]:
    """Rows that each shard must hold: all equal but for one more in the first ones."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _at(values: list[int], index: Column) -> Column:
    """values[index] for a short list, one number a shard."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), index + 1)


def _counts(rows: DataFrame, shards: int) -> list[int]:
    got = {r.shard: r.n for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a shard
    return [got.get(j, 0) for j in range(shards)]


def admissible(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the moves asked for (from, to) can be made so that no shard gains more than its room.

    A shard with room passes moves on to a node outside, from which any shard may be reached; so
    every admissible set of moves is made of cycles. Cycles are taken until none is left.
    """
    outside = len(room)
    left = [dict[int, int]() for _ in range(outside + 1)]
    for (a, b), n in sorted(asked.items()):
        if n and a != b:
            left[a][b] = n
    for b, n in enumerate(room):
        if n > 0:
            left[b][outside] = n
    left[outside] = dict.fromkeys(range(outside), sum(asked.values()))
    given: dict[tuple[int, int], int] = {}
    closed: set[int] = set()  # nodes through which no cycle runs
    for root in range(outside + 1):
        path, at = [root], {root: 0}
        while path:
            nxt = next((b for b in left[path[-1]] if b not in closed), None)
            if nxt is None:
                closed.add(path[-1])
                del at[path.pop()]
            elif nxt not in at:
                at[nxt] = len(path)
                path.append(nxt)
            else:
                cycle = [*path[at[nxt] :], nxt]
                edges = list(zip(cycle, cycle[1:], strict=False))
                n = min(left[a][b] for a, b in edges)
                for a, b in edges:
                    left[a][b] -= n
                    if not left[a][b]:
                        del left[a][b]
                    if outside not in (a, b):
                        given[a, b] = given.get((a, b), 0) + n
                for x in path[at[nxt] + 1 :]:
                    del at[x]
                del path[at[nxt] + 1 :]
    return given


def propagate(linked: DataFrame, quota: list[int], idle_rounds: int = IDLE_ROUNDS) -> DataFrame:
    """Move rows (member, group, shard) towards their groups' home shards; no shard exceeds its quota.

    After ROOM_ROUNDS each move goes where at least as many of the group are as in the shard left, so
    the sum of the squares of these numbers grows with each and the rounds come to an end.
    """
    shards, cap, total = len(quota), max(1, min(quota)), linked.count()
    now, turn, idle, roomy = linked, 0, 0, True
    while idle < idle_rounds:
        room = [q - n for q, n in zip(quota, _counts(now, shards), strict=True)]
        held = now.groupBy("group", "shard").agg(F.count("*").alias("n"))
        held = held.withColumn("size", F.sum("n").over(W.partitionBy("group")))
        # What of the group the shard holds or could still take in.
        reach = F.col("n") + F.least(_at(room, F.col("shard")), F.col("size") - F.col("n")) if roomy else F.col("n")
        salt = [] if roomy else [F.lit(turn)]
        order = W.partitionBy("group").orderBy(reach.desc(), F.col("n").desc(), F.xxhash64("group", "shard", *salt), "shard")
        ranked = held.withColumn("place", F.row_number().over(order))
        homes = ranked.where(F.col("place") <= F.ceil(F.col("size") / cap)).groupBy("group").agg(F.collect_list("shard").alias("homes"), F.first("size").alias("size"))
        asked = heavy_join(now, materialize(homes, "homes"), "group", "size", total).where(~F.array_contains("homes", F.col("shard")))
        pick = F.pmod(F.xxhash64("member", *salt), F.size("homes")) + 1
        asked = materialize(asked.select("member", "shard", F.element_at("homes", pick.cast("int")).alias("target")), "moves")
        wanted = {(r.shard, r.target): r.n for r in asked.groupBy("shard", "target").agg(F.count("*").alias("n")).collect()}  # a row a pair of shards
        if not wanted:
            break
        turn += 1
        if roomy:
            keys, most = ["target"], _at(room, F.col("target"))
            some = any(room[b] > 0 for _, b in wanted)
            roomy = some and turn < ROOM_ROUNDS
        else:
            given = admissible(wanted, room)
            keys, most = ["shard", "target"], _at([given.get((a, b), 0) for a in range(shards) for b in range(shards)], F.col("shard") * shards + F.col("target"))
            some = bool(given)
            idle = 0 if some else idle + 1
        if not some:
            continue
        ranks = global_rank(asked, keys, [F.xxhash64("member"), F.col("member")], "turn", least_buckets=256 if len(keys) == 1 else 8)
        admitted = ranks.where(F.col("turn") < most).select("member", "target")
        now = materialize(now.join(admitted, "member", "left").select("member", "group", F.coalesce("target", "shard").alias("shard")), "labels")
    return now


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, linked (whether others share its text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group"),
    )
    rows = materialize(rows, "sizes")
    total = rows.count()
    quota = quotas(total, shards)
    groups = materialize(rows.groupBy("group").agg(F.count("*").alias("n")), "groups")
    rows = materialize(heavy_join(rows, groups, "group", "n", total), "grouped")
    order = [F.xxhash64("doc_id", "group"), F.col("doc_id"), F.col("group")]
    linked = materialize(global_rank(rows.where("n > 1"), [], order, "member"), "linked")
    dealt = linked.select("member", "group", (F.col("member") % shards).cast("int").alias("shard"))
    placed = propagate(dealt, quota)
    seats = global_rank(placed.select("member", "shard"), ["shard"], [F.xxhash64("member"), F.col("member")], "slot")
    taken = _counts(placed, shards)
    ends = list(accumulate(q - n for q, n in zip(quota, taken, strict=True)))
    single = global_rank(rows.where("n = 1"), [], order, "place")
    shard = F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e <= F.col("place")))
    single = single.withColumn("shard", shard)
    slot = _at(taken, F.col("shard")) + F.col("place") - _at([0, *ends[:-1]], F.col("shard"))
    out = ["doc_id", "size", "text_crc32", "shard", "slot", "linked"]
    single = single.withColumn("slot", slot.cast("long")).withColumn("linked", F.lit(False)).select(*out)
    linked = linked.join(seats, "member").withColumn("linked", F.lit(True)).select(*out)
    both = linked.unionByName(single)
    return both.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked")
