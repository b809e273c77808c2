"""Operator 5: token ids in a fixed-width bit-packed binary format.

Every id takes ``bits`` = the bits of the largest id of the vocabulary. Ids of consecutive
documents form blocks. A block is one binary value:

    bytes 0-3   magic ``BPK1``        bytes 4-7    bits per id
    bytes 8-15  number of documents   bytes 16-23  number of ids
    then        (documents + 1) 64-bit offsets in ids from the block's first id
    then        the ids, least significant bit first, zero-padded to a whole byte

All numbers are little-endian. Blocks are stored as rows (shard, block, first id, ids, documents,
payload) of Parquet files, written by Spark's own commit protocol, so a lost executor leaves no
half-written block and any store Spark reads will do. ``read_ids`` finds the blocks that hold a
range of ids by their first id (a row-group filter), the offsets inside a block find a document, and
``unpack`` reads any run of ids with numpy without touching the rest.

Nulls and empties: a null text is empty and gives the end id alone. Rows come in ascending
doc_id order, null ids first; rows with equal ids are ordered by text. An empty table writes no
block and reads back as an empty result.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallboard.llm.common import byte_slices, parallelism, utf8

END_ID = 1
BLOCK_IDS = 1 << 20
MAGIC = b"BPK1"
BLOCKS = "shard int, block int, doc_ids array<long>, first_id long, n_ids long, payload binary"
# Words a worker remembers between batches; beyond that it starts anew.
REMEMBERED_WORDS = 1_000_000


def id_bits(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, least significant bit first."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(packed: bytes | memoryview, bits: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a packed run; only their bytes are read."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    if not count:
        return np.empty(0, np.uint32)
    first, last = start * bits, (start + count) * bits
    raw = np.frombuffer(packed, np.uint8)[first // 8:-(-last // 8)].astype(np.uint64)
    raw = np.concatenate((raw, np.zeros(8, np.uint64)))
    at = first % 8 + np.arange(count) * bits
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    word = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):  # a run of bits may begin anywhere in its first byte
        word |= raw[byte + k] << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def encode_block(ids: np.ndarray, offsets: np.ndarray, bits: int) -> bytes:
    return MAGIC + struct.pack("<IQQ", bits, len(offsets) - 1, len(ids)) + offsets.astype("<i8").tobytes() + pack(ids, bits)


def decode_block(payload: bytes) -> tuple[int, np.ndarray, memoryview]:
    """(bits, document offsets, packed ids) of a block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a packed block")
    bits, documents, _ = struct.unpack_from("<IQQ", payload, 4)
    offsets = np.frombuffer(payload, "<i8", documents + 1, 24)
    return bits, offsets, memoryview(payload)[24 + 8 * (documents + 1):]


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library.

    The tokenizer splits at white space before all else, so a text's ids are those of its
    white-space words in order, and ASCII letters may be lower-cased and ASCII punctuation after
    a letter split off beforehand. Each distinct word is encoded once: words are joined by a mark
    that is a word of its own, and the mark's ids part the result again. Words with a mark
    character are encoded alone. The tokenizer looks for its added tokens before it lower-cases, so
    texts that hold the characters of one in any case are encoded by the library as they are."""

    MARK = "☃"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = id_bits(self.tokenizer.get_vocab_size())
        self.mark = np.array(self.tokenizer.encode(self.MARK, add_special_tokens=False).ids)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.starts = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _encode_words(self, words: list[str]) -> list[np.ndarray]:
        plain = [k for k, w in enumerate(words) if self.MARK not in w]
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(words)
        chunks = [plain[at:at + 2000] for at in range(0, len(plain), 2000)]
        joined = [f" {self.MARK} ".join(words[k] for k in chunk) for chunk in chunks]
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            n = len(self.mark)
            # the mark's ids never begin inside a word's: no word holds the mark character
            hit = np.flatnonzero(np.logical_and.reduce([ids[k:len(ids) - n + 1 + k] == self.mark[k] for k in range(n)]))
            begin = np.concatenate(([0], hit + n))
            for k, a, b in zip(chunk, begin, np.concatenate((hit, [len(ids)]))):
                out[k] = ids[a:b]
        for k in set(range(len(words))) - set(plain):
            out[k] = np.array(self.tokenizer.encode(words[k], add_special_tokens=False).ids, np.uint32)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, document offsets) of the texts, each with the end id appended."""
        # a compact copy first: string kernels misread arrays whose offsets do not begin at 0
        texts = pa.concat_arrays([texts.cast(pa.large_string()), pa.array([], pa.large_string())]).fill_null("")
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
        if not special.any():
            return self._encode_plain(texts)
        ids, offsets = self._encode_plain(pc.if_else(pa.array(special), "", texts))
        rows = np.flatnonzero(special)
        own = [np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32) for k in rows.tolist()]
        many = np.zeros(len(texts), np.int64)
        many[rows] = [len(x) for x in own]
        return (np.insert(ids, np.repeat(offsets[rows], many[rows]), np.concatenate(own)),
                offsets + np.concatenate(([0], np.cumsum(many))))

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, data = utf8(texts)
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        texts = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1,
                                      [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)])
        texts = pc.replace_substring_regex(texts, r"([a-z])([.,!#$%&*])", r"\1 \2")
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.values.dictionary_encode()
        distinct = coded.dictionary
        known = pc.index_in(distinct, value_set=self.words)
        fresh = distinct.filter(pc.is_null(known))
        if len(fresh):
            if len(self.words) + len(fresh) > REMEMBERED_WORDS:
                self.forget()
                fresh = distinct
            own = self._encode_words(fresh.to_pylist())
            self.ids = np.concatenate([self.ids, *own])
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum([len(x) for x in own])))
            self.words = pa.concat_arrays([self.words, fresh])
            known = pc.index_in(distinct, value_set=self.words)
        word = known.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        bounds = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = bounds - bounds[0]
        lens = self.starts[word + 1] - self.starts[word]
        ends = np.concatenate(([0], np.cumsum(lens)))
        size = np.diff(ends[bounds]) + 1
        offsets = np.concatenate(([0], np.cumsum(size)))
        out = np.full(int(offsets[-1]), END_ID, np.uint32)
        doc = np.repeat(np.arange(len(size)), np.diff(bounds))
        source = np.repeat(self.starts[word] - ends[:-1], lens) + np.arange(int(ends[-1]))
        target = np.arange(int(ends[-1])) + np.repeat(doc, lens)
        out[target] = self.ids[source]
        return out, offsets


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, tokenizer: str, path: str, block_ids: int = BLOCK_IDS) -> None:
    """Encodes all documents and writes their blocks under ``path``; one shard per range of doc_id."""
    n = parallelism(docs.sparkSession)
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
               .withColumn("shard", F.spark_partition_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        block, first = 0, 0
        for batch in byte_slices(batches, "text", 10 << 20):
            ids, offsets = own.encode(batch.column(1))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_ids, "right")) - 1)
                a, b = int(offsets[at]), int(offsets[end])
                payload = encode_block(ids[a:b], offsets[at:end + 1] - a, own.bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(2)[0].as_py()], pa.int32()), pa.array([block], pa.int32()),
                     pa.array([batch.column(0).slice(at, end - at).to_pylist()], pa.list_(pa.int64())),
                     pa.array([first], pa.int64()), pa.array([b - a], pa.int64()), pa.array([payload], pa.binary())],
                    ["shard", "block", "doc_ids", "first_id", "n_ids", "payload"])
                block, first, at = block + 1, first + b - a, end

    ordered.mapInArrow(run, BLOCKS).write.parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The written blocks with ``first_id`` counted over all shards (one small row per shard is summed)."""
    stored = spark.read.schema(BLOCKS).parquet(path)
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("__n"))
    base = F.coalesce(F.sum("__n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("shard", base.alias("__base"))
    return stored.join(F.broadcast(totals), "shard").withColumn("first_id", F.col("first_id") + F.col("__base")).drop("__base")


def documents(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, unpacked from the written blocks."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bits, offsets, packed = decode_block(batch.column(2)[row].as_py())
                ids = unpack(packed, bits, 0, int(offsets[-1])).astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row].values, pa.array(offsets[:-1] + batch.column(1)[row].as_py(), pa.int64()),
                     pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.select("doc_ids", "first_id", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(stored: DataFrame, start: int, count: int) -> np.ndarray:
    """Random access: ids ``start`` to ``start + count`` of the whole corpus, from the blocks that hold them."""
    rows = (stored.where((F.col("first_id") < start + count) & (F.col("first_id") + F.col("n_ids") > start))
            .select("first_id", "n_ids", "payload").orderBy("first_id").collect())  # the blocks asked for
    parts = [np.empty(0, np.uint32)]
    for r in rows:
        bits, _, packed = decode_block(r.payload)
        a, b = max(start, r.first_id), min(start + count, r.first_id + r.n_ids)
        parts.append(unpack(packed, bits, a - r.first_id, b - a))
    return np.concatenate(parts)
