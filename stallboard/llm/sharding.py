"""Operator 10: resharding by minimum-cost flow.

Documents lie in old shards. The new shards take equal row counts (at most one apart), and the
plan says which rows leave their shard so that the fewest bytes move. Rows are grouped into
blocks: one per old shard and size class; the classes that hold the last row to stay in a shard, and
the next one, are cut at these two sizes exactly, so that no row that leaves is larger than one of its
shard that stays. The flow network has one node per block and shard: a block's rows stay at cost 0
or go to another shard at the block's bytes per row. Every shard takes the smaller count; the rows
beyond are shared through one more node that lets each shard take one more, so the flow itself
decides which shards are the larger ones. Successive cheapest paths solve it. Only block totals
reach the driver (old shards x ``SIZE_CLASSES``), whatever the number of documents. The plan cuts each
block's numbered rows into runs with a target shard, so every row finds its shard and its
gapless slot by arithmetic. ``write_layout`` writes the old layout, ``rewrite`` only the shards
whose rows changed, and ``read_layout`` reads the files back.

Nulls and empties: a null text has size 8 (no bytes) and the checksum of the empty text. Rows
with an old shard outside 0..shards-1 or null have no place to stay in and count as moved.
Repeated rows are separate rows. An empty table gives an empty result. Columns called ``old_shard``,
``shard`` or ``slot`` are replaced; other names never clash.
"""

from __future__ import annotations

import uuid
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallboard.llm.common import checkpointed, group_ranks, parallelism

SHARDS = 24
ROW_BYTES = 8
# Size classes per doubling; 64-bit sizes need at most 64 x CLASSES_PER_DOUBLING classes.
CLASSES_PER_DOUBLING = 4
SIZE_CLASSES = 64 * CLASSES_PER_DOUBLING


def min_cost_flow(blocks: list[tuple[int, int, float]], shards: int) -> list[tuple[int, int, int]]:
    """(block, shard, rows) with the fewest bytes moved; ``blocks`` are (old shard, rows, bytes a row).

    Every shard ends with the same number of rows, or one more. Moving costs a block's bytes a row wherever
    it goes, so all moves share one hub node; the shards' one row more comes from a pool node. Every
    augmentation pushes rows along a cheapest residual path (label-correcting search) from a
    block that has rows left to a shard that has room, or to the pool."""
    hub, pool = shards, shards + 1
    low, extra = divmod(sum(n for _, n, _ in blocks), shards)
    stay = [0] * len(blocks)
    moved = [0] * len(blocks)
    via_hub = [0] * shards
    free = [low] * shards
    larger = [0] * shards
    # dearer blocks first: a row that stays is never cheaper to move than a later one, so only
    # arrivals are ever sent on elsewhere
    order = sorted(range(len(blocks)), key=lambda b: (-blocks[b][2], b))
    for b in order:
        shard, rows, _ = blocks[b]
        left = rows
        while left:
            # nodes: shards 0..n-1, hub, pool; distance from the block to every node in the residual network
            cost = [float("inf")] * (shards + 2)
            back: list[tuple | None] = [None] * (shards + 2)
            queue: deque[int] = deque()

            def relax(node: int, c: float, edge: tuple) -> None:
                if c < cost[node] - 1e-9:
                    cost[node], back[node] = c, edge
                    queue.append(node)

            if 0 <= shard < shards:
                relax(shard, 0.0, ("stay", b, None))
            relax(hub, blocks[b][2], ("move", b, None))
            while queue:
                node = queue.popleft()
                if node == hub:
                    for j in range(shards):
                        relax(j, cost[hub], ("arrive", j, hub))
                elif node == pool:
                    for j in range(shards):
                        if larger[j]:
                            relax(j, cost[pool], ("smaller", j, pool))
                else:
                    if via_hub[node]:
                        relax(hub, cost[node], ("return", node, node))
                    if not larger[node]:
                        relax(pool, cost[node], ("larger", node, node))
            ends = [(cost[j], j) for j in range(shards) if free[j]] + ([(cost[pool], pool)] if extra else [])
            target = min(ends)[1]
            path, node = [], target
            while node is not None:
                path.append(back[node])
                node = back[node][2]
            push = min(left, extra if target == pool else free[target])
            for kind, x, _ in path:
                if kind == "return":
                    push = min(push, via_hub[x])
                elif kind in ("larger", "smaller"):
                    push = 1
            for kind, x, _ in path:
                if kind == "stay":
                    stay[x] += push
                elif kind == "move":
                    moved[x] += push
                elif kind == "arrive":
                    via_hub[x] += push
                elif kind == "return":
                    via_hub[x] -= push
                else:
                    larger[x] = int(kind == "larger")
            if target == pool:
                extra -= push
            else:
                free[target] -= push
            left -= push
    out = [(b, blocks[b][0], n) for b, n in enumerate(stay) if n]
    waiting = deque((b, n) for b, n in enumerate(moved) if n)
    for j, n in enumerate(via_hub):
        while n:
            b, have = waiting.popleft()
            take = min(have, n)
            out.append((b, j, take))
            n -= take
            if have > take:
                waiting.appendleft((b, have - take))
    return out


def text_size() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + ROW_BYTES


def _cut_sizes(light: DataFrame, totals: list, shards: int) -> dict[tuple[int, int], list[int]]:
    """Sizes at which classes are cut, by (old shard, size class): those of the last row that a shard keeps and of
    the one after it, by descending size, as the shard ends with the smaller row count or one more."""
    low = sum(r.n for r in totals) // shards
    seen, wanted = [0] * shards, []
    for r in sorted(totals, key=lambda r: -r["kind"]):
        if 0 <= r["old"] < shards:
            wanted += [(r["old"], r["kind"], k - seen[r["old"]]) for k in (low, low + 1) if seen[r["old"]] < k <= seen[r["old"]] + r.n]
            seen[r["old"]] += r.n
    wanted = [w for w in wanted if seen[w[0]] > low]
    if not wanted:
        return {}
    # two rows per old shard at most
    places = F.broadcast(light.sparkSession.createDataFrame(wanted, "old int, kind int, place long"))
    sizes = light.join(places.select("old", "kind").distinct(), ["old", "kind"]).groupBy("old", "kind", "size").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("old", "kind").orderBy(F.desc("size")))
    found = sizes.withColumn("upto", upto).join(places, ["old", "kind"]).where("upto >= place AND upto - n < place")
    cuts: dict[tuple[int, int], set[int]] = {}
    for r in found.collect():
        cuts.setdefault((r["old"], r["kind"]), set()).add(r["size"])
    return {k: sorted(v) for k, v in cuts.items()}


def _plan(light: DataFrame, shards: int) -> tuple[list[tuple], dict[tuple[int, int], list[int]]]:
    """Runs (old shard, class, part, from, to, shard, base) of numbered rows with their target, and the cut sizes."""
    def block_totals(rows: DataFrame, *keys: str) -> list:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).orderBy(*keys).collect()

    cuts = _cut_sizes(light, block_totals(light, "old", "kind"), shards)
    totals = block_totals(light.withColumn("part", _part(cuts)), "old", "kind", "part")
    flow = min_cost_flow([(r["old"], r.n, r.b / r.n) for r in totals], shards)
    runs, at, used = [], [0] * len(totals), [0] * shards
    for b, j, n in sorted(flow, key=lambda f: (f[0], f[1] != totals[f[0]]["old"], f[1])):
        runs.append((totals[b]["old"], totals[b]["kind"], totals[b]["part"], at[b], at[b] + n, j, used[j] - at[b]))
        at[b] += n
        used[j] += n
    return runs, cuts


def _part(cuts: dict[tuple[int, int], list[int]]) -> Column:
    """Part of a row's class: 2 for each cut size that it exceeds, and 1 for one that it equals."""
    part = F.lit(0)
    for (old, kind), sizes in cuts.items():  # two per shard at most
        own = sum((F.signum(F.col("size") - F.lit(x)) + 1 for x in sizes), F.lit(0))
        part = F.when((F.col("old") == old) & (F.col("kind") == kind), own).otherwise(part)
    return part.cast("int")


def _keyed(docs: DataFrame, old_shard: Column) -> list[Column]:
    return [F.coalesce(old_shard.cast("int"), F.lit(-1)).alias("old"), text_size().alias("size"),
            F.floor(F.log2(text_size()) * CLASSES_PER_DOUBLING).cast("int").alias("kind")]


def moves(docs: DataFrame, old_shard: Column, shards: int = SHARDS) -> tuple[DataFrame, list[int]]:
    """All columns of ``docs`` with ``old_shard``, ``shard`` and ``slot`` (gapless from 0 per shard), and the shards
    that lose or gain rows. Columns of these names are replaced."""
    spark = docs.sparkSession
    runs, cuts = _plan(checkpointed(docs.select(*_keyed(docs, old_shard))), shards)
    own = docs.drop("old_shard", "shard", "slot").columns
    # the row travels as one value, so no name of its columns can clash
    rows = (docs.select(F.struct(*(docs[c] for c in own)).alias("row"), *_keyed(docs, old_shard)).withColumn("part", _part(cuts)))
    # one row per run: at most blocks + shards rows
    plan = F.broadcast(spark.createDataFrame(
        runs, "old_ int, kind_ int, part_ int, from_ long, to_ long, shard int, base long"))
    parts = max(parallelism(spark) // 4, sum(r[4] - r[3] for r in runs) // 1_000_000, 1)
    ranked = group_ranks(rows, ["old", "kind", "part"], [F.col("row.doc_id"), F.xxhash64("row.text")],
                         F.concat_ws("/", F.col("row.doc_id").cast("string"), F.col("size").cast("string")), "rank", parts)
    placed = ranked.join(plan, (F.col("old") == F.col("old_")) & (F.col("kind") == F.col("kind_")) & (F.col("part") == F.col("part_"))
                         & (F.col("rank") >= F.col("from_")) & (F.col("rank") < F.col("to_")))
    moved = [(r[0], r[5]) for r in runs if r[0] != r[5]]
    return (placed.select("row.*", F.when(F.col("old") >= 0, F.col("old")).alias("old_shard"), "shard",
                          (F.col("base") + F.col("rank")).cast("long").alias("slot")),
            sorted({j for pair in moved for j in pair if j >= 0}))


def reshard(docs: DataFrame, old_shard: Column, shards: int = SHARDS) -> DataFrame:
    """All columns of ``docs`` with ``old_shard``, ``shard`` and ``slot``; see ``moves``."""
    return moves(docs, old_shard, shards)[0]


def write_layout(docs: DataFrame, old_shard: Column, path: str) -> DataFrame:
    """Writes the rows as ``path/shard=J`` by their old shard (-1 for none) and returns them read back."""
    own = [docs[c] for c in docs.columns if c not in ("old_shard", "shard", "slot")]
    old = docs.select(*own, F.coalesce(old_shard.cast("int"), F.lit(-1)).alias("shard"))
    old.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return read_layout(docs.sparkSession, path, old.schema)


def read_layout(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a layout with their ``shard``. Readers change nothing: a rewrite that was broken off is ended or
    undone by the next ``rewrite`` or by ``recover``, which only the layout's writer calls."""
    return spark.read.schema(schema).parquet(path)


def rewrite(old: DataFrame, path: str, shards: int = SHARDS) -> list[int]:
    """Reshards the layout ``old`` that was read from ``path`` and rewrites, under ``path/shard=J``, only the
    shards that lose or gain rows; returns those shards. One writer at a time.

    New folders are written aside with a list of the folders that
    end up empty, then marked as committed, then put in place by ``recover``: a rewrite that ends
    before the mark changes nothing, one that ends after it is finished by the next ``recover``."""
    spark = old.sparkSession
    recover(spark, path)
    resharded, affected = moves(old, F.col("shard"), shards)
    if not affected:
        return []
    staging = f"{path}/_rewrite-{uuid.uuid4().hex}"
    (resharded.where(F.col("shard").isin(affected)).drop("old_shard", "slot")
     .write.option("compression", "zstd").partitionBy("shard").parquet(staging))
    fs, at = _file_system(spark, path)
    filled = {s.getPath().getName() for s in fs.globStatus(at(f"{staging}/shard=*")) or []}
    for folder in fs.globStatus(at(f"{path}/shard=*")):
        name = folder.getPath().getName()
        number = int(name.split("=")[1])
        # folders of affected shards without a row left, and of rows without a shard: all their rows have moved
        if name not in filled and (number in affected or not 0 <= number < shards):
            fs.mkdirs(at(f"{staging}/_gone/{name}"))
    fs.create(at(f"{staging}/_COMMITTED")).close()
    recover(spark, path)
    return affected


def recover(spark: SparkSession, path: str) -> None:
    """Ends every committed rewrite under ``path`` and removes what others have written aside."""
    fs, at = _file_system(spark, path)
    for found in fs.globStatus(at(f"{path}/_rewrite-*")) or []:
        staging = found.getPath().toString()
        if fs.exists(at(f"{staging}/_COMMITTED")):
            for gone in fs.globStatus(at(f"{staging}/_gone/*")) or []:
                fs.delete(at(f"{path}/{gone.getPath().getName()}"), True)
            for new in fs.globStatus(at(f"{staging}/shard=*")) or []:
                place = at(f"{path}/{new.getPath().getName()}")
                fs.delete(place, True)
                if not fs.rename(new.getPath(), place):
                    raise OSError(f"{new.getPath()} could not be put in place")
        fs.delete(found.getPath(), True)


def _file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of ``path``, and its path constructor."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at
