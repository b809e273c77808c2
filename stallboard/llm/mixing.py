"""Operator 6: mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block_docs`` documents. In an ideal, endlessly divisible
stream, all sources that still have blocks run side by side at speeds in proportion to their
target weights. With sizes n_r and exact rational weights w_r this stream has run
T(v) = sum over r of min(n_r, w_r v) blocks when a source of weight w has run w v, so block k of
source s occupies the time from T(k / w_s) to T((k + 1) / w_s). It is released at the floor of the
first and due by the ceiling of the second; both are integer arithmetic, there is no period and no
rounded share. Earliest deadline first among the released blocks meets every deadline, so after any
number of slots each source is less than one block from the ideal stream: from its target until the
first source is empty, and from the renewed targets of the others afterwards.

The schedule has one small row (source, block, slot, first position) per block. Choosing the next
block depends on all before it, so one task writes them as a stream, about four seconds per million
blocks, holding one entry per source; the documents find their rows by a join that Spark plans by
size. Larger ``block_docs`` make it shorter.

Nulls and empties: null sources form one source of their own (named by ``NO_SOURCE``); null
texts count like others. Repeated rows are separate documents, ordered among themselves by
their values. Sources without a target weight get ``default_weight``; weights must be positive.
An empty table gives an empty result. Columns of the documents that are called like a result
column are replaced; other names never clash.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import accumulate
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallboard.llm.common import group_ranks, parallelism, scratch_path

BLOCK_DOCS = 16
NO_SOURCE = ""
POWER = 0.5
#: Schedule rows that the writing task holds at once.
BATCH = 1 << 17
SCHEDULE = "mix_source string, mix_block long, mix_slot long, first long"


class IdealStream:
    """Times at which the blocks of an endlessly divisible stream begin and end."""

    def __init__(self, sizes: Mapping[str, int], weights: Mapping[str, float]):
        exact = {s: Fraction(weights[s]) for s in sizes}
        if any(w <= 0 for w in exact.values()):
            raise ValueError("target weights must be positive")
        scale = lcm(*(w.denominator for w in exact.values())) if exact else 1
        #: weights as integers in the given proportions
        self.weight = {s: int(w * scale) for s, w in exact.items()}
        self.ends = sorted((Fraction(sizes[s], self.weight[s]), s) for s in sizes)
        self.near = [float(v) for v, _ in self.ends]
        #: blocks of the sources that have ended before each end, and the weight of the others
        self.ended = list(accumulate((sizes[s] for _, s in self.ends), initial=0))
        self.running = list(accumulate((-self.weight[s] for _, s in self.ends), initial=sum(self.weight.values())))

    def time(self, source: str, k: int) -> tuple[int, int]:
        """The time at which ``source`` has run ``k`` blocks, as numerator and denominator."""
        w = self.weight[source]
        j = bisect_right(self.near, k / w)
        # the floating-point place is put right by exact comparisons
        while j and self.ends[j - 1][0] * w > k:
            j -= 1
        while j < len(self.ends) and self.ends[j][0] * w <= k:
            j += 1
        return self.ended[j] * w + k * self.running[j], w

    def window(self, source: str, k: int) -> tuple[int, int]:
        """(release, deadline) of block ``k``: slots from ``release`` on, before ``deadline``."""
        begin, w = self.time(source, k)
        end, _ = self.time(source, k + 1)
        return begin // w, -(-end // w)


def edf(sizes: Mapping[str, int], weights: Mapping[str, float]) -> Iterator[tuple[str, int]]:
    """(source, block) of every slot: earliest deadline first among the released blocks."""
    sizes = {s: n for s, n in sizes.items() if n}
    ideal = IdealStream(sizes, weights)
    coming, ready = [], []

    def wait(s: str, k: int) -> None:
        if k < sizes[s]:
            release, deadline = ideal.window(s, k)
            heapq.heappush(coming, (release, deadline, s, k))

    for s in sizes:
        wait(s, 0)
    for slot in range(sum(sizes.values())):
        while coming and coming[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(coming)[1:])
        deadline, s, k = heapq.heappop(ready)
        if slot >= deadline:
            raise RuntimeError("a block missed its deadline")
        yield s, k
        wait(s, k + 1)


def damped_weights(sizes: Mapping[str, int], power: float = POWER) -> dict[str, float]:
    """Default targets: each source weighs its number of documents to the ``power``."""
    return {s: float(n) ** power for s, n in sizes.items()}


def write_schedule(spark: SparkSession, sizes: Mapping[str, int], weights: Mapping[str, float], block_docs: int) -> DataFrame:
    """(mix_source, mix_block, mix_slot, first) of every block, written in the shared folder and read back.

    ``sizes`` are documents per source; ``first`` counts the documents of all slots before."""
    if any(weights[s] <= 0 for s in sizes):
        raise ValueError("target weights must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(b.num_rows for b in batches):
            return
        last = {s: -(-n // block_docs) for s, n in sizes.items()}
        names, blocks, docs = [], [], []
        slot = first = 0

        def rows() -> pa.RecordBatch:
            upto = np.cumsum(docs, dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(blocks, pa.int64()), pa.array(np.arange(slot, slot + len(docs))),
                 pa.array(first + upto - docs)], ["mix_source", "mix_block", "mix_slot", "first"])

        for s, k in edf(last, weights):
            names.append(s)
            blocks.append(k)
            docs.append(min(block_docs, sizes[s] - k * block_docs))
            if len(docs) == BATCH:
                yield rows()
                slot, first = slot + BATCH, first + sum(docs)
                names, blocks, docs = [], [], []
        yield rows()

    path = scratch_path(spark, "mix-schedule")
    spark.range(0, 1, 1, 1).mapInArrow(run, SCHEDULE).write.parquet(path)
    return spark.read.schema(SCHEDULE).parquet(path)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block_docs: int = BLOCK_DOCS,
        power: float = POWER, default_weight: float = 1.0, prefix: str = "mix_") -> DataFrame:
    """All columns of ``docs`` with ``mix_source``, ``mix_block``, ``mix_slot`` and ``mix_position``.

    ``mix_position`` numbers the whole stream from 0 without gaps; ``prefix`` replaces ``mix_``. The driver sees
    one row per source. Within a source documents come in a hash order of their id, so a block is a random draw."""
    spark = docs.sparkSession
    own = docs.drop(*(prefix + c for c in ("source", "block", "slot", "position")))
    source = F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))
    sizes = {r.s: r.n for r in docs.groupBy(source.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    goal = damped_weights(sizes, power) if weights is None else {s: weights.get(s, default_weight) for s in sizes}
    schedule = write_schedule(spark, sizes, goal, block_docs)
    parts = max(parallelism(spark), sum(sizes.values()) // 100_000)
    # the row travels as one value, so no name of its columns can clash
    rows = own.select(F.struct(*(own[c] for c in own.columns)).alias("row"), source.alias("mix_source"))
    ranked = group_ranks(rows, ["mix_source"], [F.col("row.doc_id"), F.xxhash64("row.text")],
                         F.concat_ws("/", F.col("row.doc_id").cast("string"), F.col("mix_source")), "rank", parts)
    placed = ranked.withColumn("mix_block", F.floor(F.col("rank") / block_docs)).join(schedule, ["mix_source", "mix_block"])
    return placed.select("row.*", F.col("mix_source").alias(prefix + "source"), F.col("mix_block").alias(prefix + "block"),
                         F.col("mix_slot").alias(prefix + "slot"),
                         (F.col("first") + F.col("rank") % block_docs).cast("long").alias(prefix + "position"))
