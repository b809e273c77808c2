"""Operator 11: importance resampling towards a target distribution, ranked by parallel sorting.

Weights. Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters; the
features of a text are all runs of 1 to ``max_n`` consecutive words, joined by a space, repeats
included. A feature falls into one of ``buckets`` by its CRC-32. The gain of a bucket is the
logarithm of its smoothed share in the target texts over its share in all documents; the gains
are one array of ``buckets`` numbers, so a document is weighed by array lookups. Its score is
the floored mean gain plus Gumbel noise drawn from a hash of its id: the highest scores are a
sample without replacement with probabilities in proportion to the weights.

Ranks. Parallel sorting by regular sampling: every partition sorts its scores into a run and
offers evenly spaced keys of it; the driver sorts these keys (at most ``SAMPLE_KEYS`` and one per
run) and takes evenly spaced splitters; runs are cut at the splitters and the pieces exchanged;
each segment is merged where it arrives, and the counts of the segments before give exact ranks.
Keys that equal several splitters are dealt over all segments that may hold them, so rows
repeated any number of times do not meet in one task.

Nulls and empties: a null or wordless text has no features, weight 0, and too few words to be
drawn. A null doc_id is hashed like an empty one and comes after all ids in ties. Repeated rows
are separate rows. An empty table gives an empty result; an empty target gives every bucket the
same share. A result column that ``docs`` has already is replaced in ``resample``.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallboard.llm.common import byte_slices, checkpointed, packed_words, parallelism, utf8, word_table

BUCKETS = 10_000
MAX_N = 1
SEED = "2024"
MIN_WORDS = 20
DRAWN_PERCENT = 10
#: Keys that all runs together offer as splitters, besides one per run.
SAMPLE_KEYS = 1 << 20
SLICE_BYTES = 8 << 20
WORD = word_table("".join(c for c in map(chr, range(128)) if not c.isalnum()))
SCORES = "doc_id long, n_words long, n_features long, weight long, score long"


def features(words: pa.Array, row: np.ndarray, max_n: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(features, row of each) for every length from 1 to ``max_n``."""
    runs = words
    for n in range(1, max_n + 1):
        if n > 1:
            runs = pc.binary_join_element_wise(runs.slice(0, max(len(runs) - 1, 0)), words.slice(n - 1), pa.scalar(b" ", pa.large_binary()))
        own = row[:len(runs)]
        same = own == row[n - 1:]
        yield (runs, own) if same.all() else (runs.filter(pa.array(same)), own[same])


def bucket_numbers(column: pa.Array, buckets: int, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, row of each feature, words per row) of a column of texts."""
    offsets, data = utf8(column)
    words, row = packed_words(offsets, data, WORD)
    number, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for runs, own in features(words, row, max_n):
        coded = runs.dictionary_encode()
        known = np.array([zlib.crc32(w) % buckets for w in coded.dictionary.to_pylist()], np.int64)
        number.append(known[coded.indices.to_numpy(zero_copy_only=False)] if len(runs) else number[0])
        owner.append(own)
    return np.concatenate(number), np.concatenate(owner), np.bincount(row, minlength=len(column))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, max_n: int = MAX_N) -> np.ndarray:
    """Features per bucket over all rows; every task sends one row per bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            count += np.bincount(bucket_numbers(batch.column(0), buckets, max_n)[0], minlength=buckets)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["bucket", "n"])

    rows = (texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # one row per bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed corpus share) of every bucket."""
    n, many, wanted = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (many + n) / ((s + 1.0) * (wanted + n))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_n: int = MAX_N, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(
        gains(bucket_counts(docs, buckets, max_n), bucket_counts(target, buckets, max_n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            number, row, words = bucket_numbers(batch.column(1), buckets, max_n)
            many = np.bincount(row, minlength=len(words))
            total = np.zeros(len(words), np.int64)
            np.add.at(total, row, gain[number])
            weight = total // np.maximum(many, 1)
            score = weight + np.array([noise(d, seed) for d in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, many, weight, score))],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORES)


_KEY = ("negative", "absent", "id", "weight", "features")


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """Sort keys (rows x 5): score descending, rows without id last, id, weight, features."""
    ids = batch.column("doc_id")
    return np.stack([-batch.column("score").to_numpy(zero_copy_only=False), np.asarray(pc.is_null(ids)).astype(np.int64),
                     pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), batch.column("weight").to_numpy(zero_copy_only=False),
                     batch.column("n_features").to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)


def sorted_runs(scored: DataFrame, runs: int, offered: int) -> DataFrame:
    """``scored`` as at most ``runs`` sorted partitions; ``offered`` evenly spaced rows of each are marked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        table = pa.Table.from_batches(own).combine_chunks()
        order = np.lexsort(_keys(table.to_batches()[0]).T[::-1])
        marked = np.zeros(len(order), bool)
        marked[np.unique(np.arange(offered) * len(order) // offered)] = True
        table = table.take(pa.array(order)).append_column("offered", pa.array(marked))
        yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    return scored.coalesce(runs).mapInArrow(run, f"{SCORES}, offered boolean")


def splitters(runs: DataFrame, segments: int) -> np.ndarray:
    """At most ``segments`` - 1 evenly spaced keys among those that the runs offer."""
    rows = runs.where("offered").drop("offered", "n_words").collect()  # SAMPLE_KEYS and one per run at most
    keys = sorted((-r.score, r.doc_id is None, r.doc_id or 0, r.weight, r.n_features) for r in rows)
    at = np.arange(1, segments) * len(keys) // segments
    return np.array([keys[k] for k in at] if keys else [], np.int64).reshape(-1, len(_KEY))


def segment_of(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Segment of each key: the number of splitters below it; keys equal to splitters are dealt over all
    segments that may hold them."""
    order = np.lexsort(np.concatenate((cuts, keys)).T[::-1])
    both = np.concatenate((cuts, keys))[order]
    new = np.ones(len(both), bool)
    new[1:] = (both[1:] != both[:-1]).any(axis=1)
    place = np.empty(len(both), np.int64)
    place[order] = np.cumsum(new)
    low = np.searchsorted(place[:len(cuts)], place[len(cuts):], "left")
    high = np.searchsorted(place[:len(cuts)], place[len(cuts):], "right")
    return low + np.arange(len(keys)) % (high - low + 1)


def rank_rows(scored: DataFrame, segments: int | None = None) -> DataFrame:
    """``scored`` rows with ``rank`` 1, 2, 3... by score descending, then doc_id ascending."""
    spark = scored.sparkSession
    n = segments or parallelism(spark)
    runs = checkpointed(sorted_runs(scored, n, max(1, min(n, SAMPLE_KEYS // n))))
    cuts = spark.sparkContext.broadcast(splitters(runs, n))  # one key per segment

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = segment_of(_keys(batch), cuts.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], [*batch.schema.names, "segment"])

    pieces = runs.drop("offered").mapInArrow(cut, f"{SCORES}, segment int")
    before, counts = 0, []
    for r in sorted(pieces.groupBy("segment").count().collect()):  # one row per segment
        counts.append((r.segment, before))
        before += r["count"]
    offsets = F.broadcast(spark.createDataFrame(counts, "segment int, before long"))
    merged = Window.partitionBy("segment").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features")
    return (pieces.withColumn("place", F.row_number().over(merged)).join(offsets, "segment")
            .select(*scored.columns, (F.col("before") + F.col("place")).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, min_words: int = MIN_WORDS,
          buckets: int = BUCKETS, max_n: int = MAX_N, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; rank is null where not drawn.

    Of the N rows with at least ``min_words`` words the floor(``percent`` N / 100) highest scores are drawn."""
    scored = checkpointed(weigh(docs, target, buckets, max_n, seed))
    enough: Column = F.col("n_words") >= min_words
    many = scored.where(enough).count() * percent // 100
    ranked = rank_rows(scored.where(enough))
    rank = F.when(F.col("rank") <= many, F.col("rank")).alias("rank")
    return ranked.select(*scored.columns, rank).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The drawn documents with all their columns, and weight, score and rank. Documents are told apart by
    doc_id: all rows of a drawn id stay, each with the id's best rank."""
    chosen = (drawn(docs, target, **parameters).where("rank IS NOT NULL").groupBy("doc_id")
              .agg(F.min(F.struct("rank", "weight", "score")).alias("best")).withColumnsRenamed({"doc_id": "drawn id"}))
    own = docs.drop("weight", "score", "rank")
    return (own.join(chosen, own["doc_id"].cast("long").eqNullSafe(F.col("drawn id")))
            .select(*(own[c] for c in own.columns), "best.weight", "best.score", "best.rank"))
