"""The corpus pipeline: language, near duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's
result as Parquet in the shared folder and reads it back as the next stage's documents.

Nulls and empties: a null or letterless text has no language and goes in the first stage; later
stages follow their operators' rules. An empty table gives an empty result. Extra columns of the
documents pass through unchanged, whatever they are called: the mixing stage hands the stream's order on
in two columns with generated names, and where the documents have a column ``old_shard``, ``shard`` or
``slot`` of their own, the result's column of that name gets underscores appended.

The results of the stages and the written shards lie under ``spark.checkpoint.dir``. ``run`` removes each stage's
files once the next one is written; those that the returned DataFrame reads belong to the caller.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallboard.llm import decontaminate, language_id, mixing, sharding, simhash_dedup
from stallboard.llm.common import group_ranks, parallelism, read, remove_path, scratch_path, ship_package

#: No stage of this pipeline can be stated in SQL alone (a trained network, SimHash over XXH64,
#: alignments, schedules): its tests compare run() with a brute-force version.
ORACLE_SQL = None
#: Names of the columns that carry the mixed stream's order from the mixing to the sharding stage.
STREAM = re.compile(r"stream_(position|rank)_[0-9a-f]{32}")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language cannot be told (operator 3)."""
    ship_package(spark)
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class (operator 8)."""
    ship_package(spark)
    return simhash_dedup.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents into which a benchmark item leaks (operator 2)."""
    return decontaminate.remove_leaking(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixed stream (operator 6): files and rows follow it.

    ``stream_position_...`` holds the order for the next stage, ``stream_rank_...`` a number of the document
    within its source that goes up block by block."""
    ship_package(spark)
    own = uuid.uuid4().hex
    mixed = mixing.mix(docs, prefix=own)
    block, position = F.col(f"{own}block"), F.col(f"{own}position")
    rank = block * mixing.BLOCK_DOCS + position % mixing.BLOCK_DOCS
    mixed = mixed.select(*docs.columns, position.alias(f"stream_position_{own}"), rank.alias(f"stream_rank_{own}"))
    return mixed.repartitionByRange(parallelism(spark), f"stream_position_{own}").sortWithinPartitions(f"stream_position_{own}")


def dealt_shard(shards: int, rank: Column) -> Column:
    """The old layout of the last stage: each source's documents are dealt to all shards in turn, so
    that every shard holds an equal part of every source's stream."""
    source = F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary"))
    return ((rank + source) % shards).cast("int")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot in equal shards (operator 10), read back from the rewritten
    shards; the slots of a shard follow the order of the mixed stream."""
    ship_package(spark)
    position, rank = [c for c in docs.columns if STREAM.fullmatch(c)][-2:]
    own = [c for c in docs.columns if c not in (position, rank)]
    hidden = {c: f"{c}_{uuid.uuid4().hex}" for c in own if c in ("old_shard", "shard", "slot")}
    path = scratch_path(spark, "pipeline-shards")
    old = sharding.write_layout(docs.withColumnsRenamed(hidden), dealt_shard(sharding.SHARDS, F.col(rank)), path)
    sharding.rewrite(old, path)
    new = sharding.read_layout(spark, path, old.schema)
    parts, rows = max(parallelism(spark) // 4, 1), max(new.count(), 1)
    ranked = group_ranks(new, ["shard"], [F.col(position)], F.col(position), "slot", parts, F.floor(F.col(position) * parts / rows))
    results = {}
    for name, value in (("old_shard", dealt_shard(sharding.SHARDS, F.col(rank))), ("shard", F.col("shard")), ("slot", F.col("slot"))):
        while name in own:
            name += "_"
        results[name] = value
    return ranked.select(*(F.col(hidden.get(c, c)).alias(c) for c in own), *(v.alias(c) for c, v in results.items()))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read back."""
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
