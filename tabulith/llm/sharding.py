"""Sharding by a minimax contiguous partition of ordered atomic groups.

Documents with equal texts are a group and stay together. Groups are ordered: those
that are heavy (over 1/4096 of all bytes, so 4096 at most) first, then all others by the
digest of their text. The smallest capacity with which a greedy walk over this order
fills at most the wanted number of shards is found by binary search, and the shards are
cut with that capacity, each as near to an even share as it allows. The walks are made on
sums of runs of groups; only runs in which a cut can fall are looked at more closely,
level by level, until every cut is between two known groups, so the driver holds a
bounded number of sums whatever the number of groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.llm.common import documents, picked, written

#: Shards, bytes that a document counts beside its text, hex digits of the first runs' digests.
SHARDS, OVERHEAD, FIRST_DIGITS = 40, 16, 3
#: Groups that are fetched one by one once the runs in question hold no more.
FETCHED = 50_000
#: Chunks of a shard in which slots are numbered side by side.
CHUNKS = 1024


class Run(NamedTuple):
    """Groups whose digests start with `prefix`: their bytes and number; one group is atomic."""

    prefix: str
    size: int
    groups: int


def shards_needed(runs: list[Run], capacity: int, fluid: bool) -> int:
    """Shards that a greedy walk fills. A run of several groups is taken whole or, if fluid, cut anywhere."""
    shards, room = 1, capacity
    for run in runs:
        if fluid and run.groups > 1:
            if run.size > room:
                more = -(-(run.size - room) // capacity)
                shards += more
                room += more * capacity
        elif run.size > capacity:
            return len(runs) + 2**31
        elif run.size > room:
            shards += 1
            room = capacity
        room -= run.size
    return shards


def smallest_capacity(runs: list[Run], shards: int, fluid: bool = False) -> int:
    """The smallest capacity with which the walk fills at most `shards`, by binary search."""
    total = sum(r.size for r in runs)
    low, high = -(-total // shards), max(total, 1)
    while low < high:
        middle = (low + high) // 2
        if shards_needed(runs, middle, fluid) <= shards:
            high = middle
        else:
            low = middle + 1
    return high


def cuts(runs: list[Run], capacity: int, fluid: bool = False) -> list[int]:
    """The numbers of the runs with which the second and later shards start; fluid: in which the cuts fall."""
    found, room = [], capacity
    for i, run in enumerate(runs):
        if fluid and run.groups > 1:
            while run.size > room:
                found.append(i)
                room += capacity
        elif run.size > room:
            found.append(i)
            room = capacity
        room -= run.size
    return found


def in_question(runs: list[Run], shards: int) -> tuple[list[int], int]:
    """Runs of several groups in which a cut of the best partition can fall, and the capacity for whole runs.

    The best capacity is at most that for whole runs and at least that for runs cut
    anywhere; a walk with the least capacity and whole runs comes no further than the best
    walk, one with the greatest and fluid runs no less far.
    """
    low, high = smallest_capacity(runs, shards, fluid=True), smallest_capacity(runs, shards)
    several = [i for i, r in enumerate(runs) if r.groups > 1]
    if any(r.size > low for r in runs):
        return several, high
    early, late = cuts(runs, low)[: shards - 1], cuts(runs, high, fluid=True)
    late += [len(runs) - 1] * (len(early) - len(late))
    near = {i for a, z in zip(early, late, strict=False) for i in range(a, z + 1)}
    return [i for i in several if i in near], high


def even_cuts(runs: list[Run], shards: int, capacity: int) -> list[int]:
    """Cuts as in cuts(), with no shard over capacity, each as near as can be to an even share of what is left.

    A walk from the end tells how early a cut may be for the rest to fit; the greedy walk
    would fill all shards but the last ones up to the capacity instead.
    """
    sums = [0]
    for run in runs:
        sums.append(sums[-1] + run.size)
    earliest = [len(runs)]  # where the last 0, 1, 2 ... shards can start at the earliest
    for _ in range(shards - 1):
        earliest.append(bisect_left(sums, sums[earliest[-1]] - capacity))
    found, at = [], 0
    for left in range(shards - 1, 0, -1):
        first, last = max(earliest[left], at + 1), bisect_right(sums, sums[at] + capacity) - 1
        if first >= len(runs):
            break
        wanted = sums[at] + (sums[-1] - sums[at]) / (left + 1)
        near = bisect_left(sums, wanted)
        if near > 0 and wanted - sums[near - 1] <= sums[min(near, len(runs))] - wanted:
            near -= 1
        at = min(max(near, first), max(first, min(last, len(runs) - left)))  # a run for each later shard, where there are enough
        found.append(at)
    return found


def _ranges(prefixes: list[str]) -> Column:
    """Whether a key starts with one of the prefixes, neighbours taken together."""
    wide: list[list[str]] = []
    for p in prefixes:  # in order; a neighbour is the next number of as many digits
        if wide and len(wide[-1][1]) == len(p) and int(wide[-1][1], 16) + 1 == int(p, 16):
            wide[-1][1] = p
        else:
            wide.append([p, p])
    test = F.lit(False)
    for a, z in wide:
        test = test | ((F.col("key") >= a) & (F.col("key") < z + "g"))
    return test


def _runs(groups: DataFrame, digits: int, where: Column | None = None) -> list[Run]:
    rows = (groups if where is None else groups.where(where)).groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    return sorted(Run(r["p"], int(r["s"]), r["n"]) for r in rows)


def _finer(light: DataFrame, runs: list[Run], marked: list[int]) -> list[Run]:
    """The runs with those marked taken apart by more digits, or to single groups once there are few in them."""
    few = sum(runs[i].groups for i in marked) <= FETCHED
    digits = 32 if few else 1 + max(len(runs[i].prefix) for i in marked)
    prefixes = [runs[i].prefix for i in marked]
    parts: dict[str, list[Run]] = {}
    for run in _runs(light, digits, _ranges(prefixes)):
        parts.setdefault(prefixes[bisect_right(prefixes, run.prefix) - 1], []).append(run)
    inside = set(marked)
    return [x for i, run in enumerate(runs) for x in (parts[run.prefix] if i in inside else [run])]


def partition(groups: DataFrame, shards: int) -> tuple[dict[str, int], list[str], int, int]:
    """How groups(key, size) go to shards: heavy keys with their shard, then for the others
    the first key of each later shard, the number of the shard where they start, and the capacity."""
    total = groups.agg(F.sum("size")).first()[0]
    if total is None:
        return {}, [], 0, 0
    heavy = sorted(Run(r["key"], int(r["size"]), 1) for r in groups.where(F.col("size") > int(total) // 4096).collect())
    light = groups.where(F.col("size") <= int(total) // 4096)
    runs = heavy + _runs(light, FIRST_DIGITS)
    capacity, starts, even = 0, [], False
    while True:
        if not even:  # first the capacity, from runs in which a cut of the greedy walk can fall
            marked, capacity = in_question(runs, shards)
            even = not marked
        if even:  # then the cuts, from the runs on their two sides
            starts = even_cuts(runs, shards, capacity)
            marked = sorted({i for s in starts for i in (s - 1, s) if runs[i].groups > 1})
            if not marked:
                break
        runs = _finer(light, runs, marked)
    of_heavy, n = {}, len(heavy)
    for i, run in enumerate(heavy):
        of_heavy[run.prefix] = sum(s <= i for s in starts)
    return of_heavy, [runs[s].prefix for s in starts if s > n] if n < len(runs) else [], sum(s <= n for s in starts), capacity


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs(doc_id, text).

    The law is `bytes`: sizes of shards are as equal as whole groups of equal texts in
    their order allow. A null text counts as empty, and both are one group. Rows with
    repeated or null doc_ids are rows of their own. Slots number the rows of a shard
    without gaps, chunk by chunk, so no task holds a whole shard. Empty input gives no
    rows; other columns are left out. DataFrame functions only.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))
    rows = written(rows, "rows")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    heavy, firsts, start, _ = partition(groups, shards)
    shard = F.lit(start)
    for key in firsts:  # one for each later shard
        shard = shard + (F.col("key") >= key).cast("int")
    rows = rows.withColumn("light_shard", shard)
    if heavy:
        # 4096 rows at most
        known = docs.sparkSession.createDataFrame(list(heavy.items()), "key string, heavy_shard int")
        rows = rows.join(F.broadcast(known), "key", "left").withColumn("shard", F.coalesce("heavy_shard", "light_shard"))
    else:
        rows = rows.withColumnRenamed("light_shard", "shard")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "key", F.monotonically_increasing_id()), F.lit(CHUNKS)))
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "key", "size")) - 1
    placed = rows.withColumn("place", place).join(counts, ["shard", "chunk"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sharded() of all documents, in 40 shards."""
    return sharded(documents(spark, sf_dir))
