"""Operator 8: near duplicates by SimHash with anchor-point covering.

A fingerprint has 64 bits. Bits 0-22 and bits 23-45 are each covered by the perfect binary
Golay code (23 bits, 4096 code words, covering radius 3); an anchor is a pair of code words.
Every fingerprint has one home anchor (a code word within radius 3 of each half) and is
replicated to every anchor within the covering radius plus the link threshold. If x and y
differ in at most t bits, y is within (3 + t1, 3 + t2), t1 + t2 <= t, of x's home anchor, so
the two meet there and no link is lost. Only distinct fingerprints are replicated and compared;
documents with equal fingerprints are linked by their key.

Nulls and empties: a null or word-less text has fingerprint zero and is linked like any other;
so are rows with a null doc_id: components are taken over fingerprints, and a row's component_id is
the smallest id in its component (null if no row of it has an id). One doc_id on several texts is
several rows, which share nothing but the id. Repeated rows are separate rows with equal results.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallboard.llm.common import checkpointed, connected_components

SHINGLE = 3
MAX_DISTANCE = 2
SEED = 42
# Length, radius and generator polynomial of the binary Golay code.
GOLAY_BITS = 23
GOLAY_RADIUS = 3
GOLAY_POLY = 0xC75


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED)
                  for s, e in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp): a 64-bit hash and the signed 64-bit fingerprint of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       text_key().alias("text_key")).mapInArrow(run, "doc_id long, text_key long, fp long")


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


@lru_cache(maxsize=None)
def _syndromes(values: int = 1 << GOLAY_BITS) -> np.ndarray:
    """Remainder modulo the generator polynomial of every 23-bit word."""
    s = np.arange(values, dtype=np.uint32)
    for bit in range(GOLAY_BITS - 1, 10, -1):
        s ^= ((s >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GOLAY_POLY << (bit - 11))
    return s.astype(np.uint16)


@lru_cache(maxsize=None)
def _patterns(threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Error patterns by syndrome, one (starts, patterns) list per excess 0..threshold over the radius.

    Pattern e with the syndrome of a word y makes y ^ e a code word at distance popcount(e)."""
    words = np.arange(1 << GOLAY_BITS, dtype=np.uint32)
    weight = np.bitwise_count(words)
    out = []
    for excess in range(threshold + 1):
        own = words[weight <= GOLAY_RADIUS] if excess == 0 else words[weight == GOLAY_RADIUS + excess]
        syn = _syndromes()[own]
        order = np.argsort(syn, kind="stable")
        out.append((np.searchsorted(syn[order], np.arange(2049)), own[order].astype(np.int64)))
    return out


def _expand(syn: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and patterns: row i repeated for each pattern of syndrome ``syn[i]``."""
    starts, patterns = table
    lens = starts[syn + 1] - starts[syn]
    rows = np.repeat(np.arange(len(syn)), lens)
    first = np.cumsum(lens) - lens
    return rows, patterns[np.arange(len(rows)) - first[rows] + starts[syn][rows]]


def anchors(fps: np.ndarray, threshold: int, home: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of the home anchors, or of all anchors within radius plus ``threshold``."""
    fps = fps.view(np.uint64)
    mask = np.uint64((1 << GOLAY_BITS) - 1)
    lo = (fps & mask).astype(np.int64)
    hi = ((fps >> np.uint64(GOLAY_BITS)) & mask).astype(np.int64)
    syn = _syndromes()
    table = _patterns(0 if home else threshold)
    rows, found = [], []
    for e1 in range(1 if home else threshold + 1):
        row1, p1 = _expand(syn[lo].astype(np.int64), table[e1])
        for e2 in range(1 if home else threshold + 1 - e1):
            row2, p2 = _expand(syn[hi[row1]].astype(np.int64), table[e2])
            row = row1[row2]
            rows.append(row)
            found.append((lo[row] ^ p1[row2]) | ((hi[row] ^ p2) << GOLAY_BITS))
    return np.concatenate(rows), np.concatenate(found)


def links(nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): pairs of fingerprints at most ``max_distance`` bits apart, a < b as signed numbers.

    ``nodes`` has one row (fp) per distinct fingerprint."""
    def spread(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 20_000):
                    fps = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False)
                    row, anchor = anchors(fps, max_distance, home)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[row])], ["anchor", "fp"])
        return run

    own = nodes.select("fp")
    homes = own.mapInArrow(spread(True), "anchor long, fp long").alias("h")
    copies = own.mapInArrow(spread(False), "anchor long, fp long").alias("c")
    near = F.bit_count(F.col("h.fp").bitwiseXOR(F.col("c.fp"))) <= max_distance
    return (copies.join(homes, (F.col("h.anchor") == F.col("c.anchor")) & near & (F.col("h.fp") < F.col("c.fp")))
            .select(F.col("h.fp").alias("a"), F.col("c.fp").alias("b")))


def _classes(nodes: DataFrame, max_distance: int) -> DataFrame:
    """``nodes`` with ``root``: the smallest fingerprint of each one's component."""
    roots = connected_components(links(nodes, max_distance), "a", "b")
    return nodes.join(roots, nodes.fp == roots.node, "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id): whole-corpus near-duplicate classes."""
    fps = checkpointed(fingerprints(docs, shingle))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("label")))
    classes = checkpointed(_classes(nodes, max_distance))
    least = classes.groupBy("root").agg(F.min("label").alias("component_id"))
    return (fps.join(classes.join(least, "root").select("fp", "component_id"), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Keeps one row of each class with all its columns: the smallest by doc_id (rows without one last), then by a
    hash of the text; of rows that agree in both, one."""
    fps = checkpointed(fingerprints(docs, shingle))
    classes = _classes(checkpointed(fps.select("fp").distinct()), max_distance)
    rank = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")
    keep = fps.join(classes, "fp").groupBy("root").agg(F.min(rank).alias("first")).select(
        "root", F.col("first.doc_id").alias("kept id"), F.col("first.text_key").alias("kept text"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"),
                       text_key().alias("key"))
    # repeated rows meet again as one row per task before they are shuffled
    return (rows.join(keep, F.col("id").eqNullSafe(F.col("kept id")) & (F.col("key") == F.col("kept text")))
            .groupBy("root").agg(F.first("row").alias("row")).select("row.*"))
