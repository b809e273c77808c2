"""Operator 7: exact repeated substrings by difference-cover blockwise suffix sorting.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else in the corpus is
removed. All suffixes are cut at ``LENGTH`` bytes, so "starts elsewhere too" means a tie of the
cut suffixes.

Cover sample. A perfect difference set modulo ``V`` has 17 residues and holds every difference:
for any two places i, j there is one d < V with i + d and j + d both in the sample. If the
strings at i and j agree on ``LENGTH`` bytes, the sample suffixes at i + d and j + d agree on
``DEPTH`` = LENGTH - V + 1 bytes. The sample suffixes (one place in 16), cut at DEPTH bytes, are
therefore sorted first, bucket by bucket: a bucket holds the sample suffixes whose key begins with the
same bits and is sorted on its own. Only places within reach of a tied sample suffix can be long
ties; all other suffixes are settled by the sample and are never moved.

Blockwise sort. The remaining suffixes are again sorted one bucket at a time, by a 64-bit key of
their ``LENGTH`` bytes and then by a second, independent key: equal keys are long ties. A bucket
answers a block with one bit per suffix, in the order in which the block sent them.

Keys instead of ranks. A shared-memory sorter numbers the sample suffixes by rank and compares the bytes
of two suffixes before it. Here the bytes of two suffixes are rarely on one machine, and only equality
matters, so no rank is kept: suffixes are compared by fixed-width keys of their bytes (polynomial hashes), and the
order of a bucket is that of its keys. Equal keys (64 + 16 bits and the bucket) are taken for equal strings.

Documents lie in blocks by a hash of their id. A block sends each key once however often it
holds it, so a string that occurs in a third of all documents is one row per block. Exact copies
of a text take no part beyond their smallest row.

Nulls and empties: null counts as empty: no bytes, nothing removed. A text shorter than LENGTH
keeps all bytes. Repeated rows are copies of each other. Rows with a null doc_id take part like
others. An empty table gives an empty result. A very long text is worked on in pieces of ``PIECE_BYTES``
that overlap by LENGTH - 1 bytes, so that each string starts in one of them. ``text`` is what is left of a text;
bytes of a character that was cut through become U+FFFD there (``kept_sha256`` is of the bytes themselves).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallboard.llm.common import checkpointed, parallelism

LENGTH = 400
#: Fixed value: the perfect difference set modulo 273 (Singer, order 16) is found by ``difference_cover``.
V = 273
BLOCK_BYTES = 4 << 20
BUCKET_ENTRIES = 1 << 20
PIECE_BYTES = 1 << 20
BASE = (0x9E3779B97F4A7C15 | 5, 0xD1B54A32D192ED03 | 5)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def difference_cover(v: int = V, size: int = 17) -> np.ndarray:
    """A perfect difference set of ``size`` residues modulo ``v`` (v = size^2 - size + 1).

    Singer's construction: the points of a line in the projective plane over GF(16), found as
    powers of a generator of GF(16^3) whose trace-like linear form vanishes."""
    # GF(2^12) by its primitive polynomial x^12 + x^6 + x^4 + x + 1; GF(16) are the powers of g^273
    order, poly = (1 << 12) - 1, 0x1053
    exp = [1]
    for _ in range(order - 1):
        x = exp[-1] << 1
        exp.append(x ^ poly if x >> 12 else x)
    log = {x: k for k, x in enumerate(exp)}

    def power(x: int, n: int) -> int:
        return exp[log[x] * n % order] if x else 0

    cover = [k for k in range(v) if power(exp[k], 1) ^ power(exp[k], 16) ^ power(exp[k], 256) == 0]
    if len(cover) != size or len({(a - b) % v for a in cover for b in cover}) != v:
        raise ValueError("no perfect difference set")
    return np.array(cover, np.int64)


@lru_cache(maxsize=1)
def cover() -> np.ndarray:
    return difference_cover()


class Keys:
    """Polynomial keys, modulo 2^64, of any window of a byte string.

    Each byte stands for a fixed pseudo-random 64-bit number; a window's key is the polynomial of
    its bytes' numbers, taken from prefix sums, then mixed."""

    def __init__(self, data: np.ndarray, which: int = 0):
        table = _byte_numbers(which)
        n = len(data)
        self.powers = _powers(n + 1, BASE[which])
        self.inverse = _powers(n + 1, pow(BASE[which], -1, 1 << 64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * self.powers[:n], out=self.sums[1:])

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        key = (self.sums[places + length] - self.sums[places]) * self.inverse[places]
        key ^= key >> np.uint64(31)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
        return key


@lru_cache(maxsize=2)
def _byte_numbers(which: int) -> np.ndarray:
    return np.random.default_rng(20 + which).integers(0, 1 << 64, 256, np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        out = np.ones(size, np.uint64)
        done = 1
        step = base % (1 << 64)
        while done < size:  # doubling: out[done:2 done] = out[:done] * base^done
            end = min(2 * done, size)
            out[done:end] = out[:end - done] * np.uint64(step)
            step = step * step % (1 << 64)
            done = end
        _POWERS[base] = have = out
    return have[:n]


def sample_places(n: int, length: int) -> np.ndarray:
    """Cover places of a text of ``n`` bytes whose windows of ``length`` - V + 1 bytes lie inside."""
    depth = length - V + 1
    periods = max(0, n - depth) // V + 1
    places = (np.arange(periods)[:, None] * V + cover()[None, :]).ravel()
    return places[places <= n - depth]


def candidate_places(n: int, tied: np.ndarray, length: int) -> np.ndarray:
    """Places of a text from which a tied sample suffix is within reach: the only possible long ties."""
    if not len(tied) or n < length:
        return np.empty(0, np.int64)
    mark = np.zeros(n - length + 2, np.int32)
    np.add.at(mark, np.maximum(tied - V + 1, 0).clip(max=n - length + 1), 1)
    np.add.at(mark, np.minimum(tied + 1, n - length + 1), -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _text_rows(docs: pd.DataFrame, status: dict[tuple, int]) -> Iterator[tuple[int | None, np.ndarray, int]]:
    """(doc_id, bytes, status) of a block's rows, in a fixed order. Status 0: unique text, 1: first of
    its copies, 2: a further copy. Of repeated rows with one id the first counts as itself."""
    seen: set = set()
    order = sorted(range(len(docs)), key=lambda k: (docs["row_key"].iat[k], docs["text_key"].iat[k]))
    for k in order:
        own = (docs["row_key"].iat[k], docs["text_key"].iat[k])
        state = status.get(own, 0)
        if state == 1 and own in seen:
            state = 2
        seen.add(own)
        doc_id = docs["doc_id"].iat[k]
        yield (None if doc_id is None else int(doc_id)), _bytes(docs["text"].iat[k]), state


def _status(notes: pd.DataFrame) -> dict[tuple, int]:
    own = notes[notes["kind"] == STATUS]
    return {(r, t): s for r, t, s in zip(own["row_key"], own["text_key"], own["bucket"])}


ENTRIES = "bucket long, block long, keys binary, seconds binary, twice binary"
NOTES = "block long, kind int, bucket long, row_key long, text_key long, tied binary"
STATUS, SAMPLES, SUFFIXES = 0, 1, 2


class Entries:
    """The distinct (bucket, key, second) suffix keys of one block, in that order."""

    def __init__(self, bucket: np.ndarray, key: np.ndarray, second: np.ndarray):
        order = np.lexsort((second, key, bucket))
        bucket, key, second = bucket[order], key[order], second[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1]) | (bucket[1:] != bucket[:-1])
        first = np.flatnonzero(new)
        self.bucket, self.key, self.second = bucket[first], key[first], second[first]
        self.twice = np.diff(np.append(first, len(key))) > 1
        #: for each given suffix its place among the distinct ones
        self.place = np.empty(len(key), np.int64)
        self.place[order] = np.cumsum(new) - 1
        cuts = np.flatnonzero(np.diff(self.bucket)) + 1
        self.cuts = np.concatenate(([0], cuts, [len(first)])) if len(first) else np.zeros(1, np.int64)

    def rows(self, block: int) -> pd.DataFrame:
        """One row per bucket that this block has suffixes for."""
        out = [(int(self.bucket[a]), block, self.key[a:b].tobytes(), self.second[a:b].tobytes(), np.packbits(self.twice[a:b]).tobytes())
               for a, b in zip(self.cuts, self.cuts[1:])]
        return pd.DataFrame(out, columns=["bucket", "block", "keys", "seconds", "twice"])

    def tied(self, notes: pd.DataFrame, kind: int) -> np.ndarray:
        """For each given suffix whether its bucket found it tied."""
        own = notes[notes["kind"] == kind]
        found = dict(zip(own["bucket"], own["tied"]))
        out = np.zeros(len(self.key), bool)
        for a, b in zip(self.cuts, self.cuts[1:]):
            if (bits := found.get(int(self.bucket[a]))) is not None:
                out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        return out[self.place]


def sample_entries(texts: list[np.ndarray], length: int, buckets: int) -> tuple[Entries, list[np.ndarray]]:
    """Sample suffixes of a block by (bucket, 32-bit key), and their places in each text.

    A bucket holds about ``BUCKET_ENTRIES`` keys at any corpus size, so few keys agree by
    chance; such a chance tie only adds candidates."""
    places = [sample_places(len(t), length) for t in texts]
    key = np.concatenate([np.empty(0, np.uint64), *(Keys(t).at(p, length - V + 1) for t, p in zip(texts, places))])
    return Entries(((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), key.astype(np.uint32), np.zeros(len(key), np.uint8)), places


def suffix_entries(texts: list[np.ndarray], places: list[np.ndarray], tied: np.ndarray, length: int,
                   buckets: int) -> tuple[Entries, list[np.ndarray]]:
    """Possible long ties of a block by (bucket, 64-bit key, 16-bit second key), and their places.

    The bucket comes from the upper half of the second key's 32 bits, so equal entries agree on all of
    64 + 16 bits and the bucket."""
    ends = np.cumsum([len(p) for p in places])
    own = [candidate_places(len(t), p[flag], length) for t, p, flag in zip(texts, places, np.split(tied, ends[:-1]))] if texts else []
    key = [np.empty(0, np.uint64), *(Keys(t).at(p, length) for t, p in zip(texts, own) if len(p))]
    second = [np.empty(0, np.uint64), *(Keys(t, 1).at(p, length) for t, p in zip(texts, own) if len(p))]
    key, second = np.concatenate(key), np.concatenate(second)
    return Entries(((second >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), key, second.astype(np.uint16)), own


def _sort_bucket(kind: int, key_type: type, second_type: type):
    """Sorts one bucket; answers each block which of its entries tie with another suffix."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, key_type) for k in rows["keys"]]
        lens = np.array([len(k) for k in keys])
        key = np.concatenate(keys)
        second = np.concatenate([np.frombuffer(k, second_type) for k in rows["seconds"]])
        order = np.argsort(key, kind="stable") if kind == SAMPLES else np.lexsort((second, key))
        key, second = key[order], second[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = (key[1:] == key[:-1]) & (second[1:] == second[:-1])
        tie = np.empty(len(key), bool)
        tie[order] = same[1:] | same[:-1]
        tie |= np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(rows["twice"], lens)]).astype(bool)
        out = [(block, kind, bucket, 0, 0, np.packbits(own).tobytes())
               for block, bucket, own in zip(rows["block"], rows["bucket"], np.split(tie, np.cumsum(lens)[:-1])) if own.any()]
        return pd.DataFrame(out, columns=["block", "kind", "bucket", "row_key", "text_key", "tied"])
    return run


def pieces(data: np.ndarray, length: int, size: int = PIECE_BYTES) -> list[np.ndarray]:
    """Parts of a text such that every ``length``-byte string starts in exactly one, ``size`` strings in each but the last."""
    return [data[at:at + size + length - 1] for at in range(0, len(data) - length + 1, size)]


def covered(size: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Bytes covered by the windows that start at ``starts``."""
    mark = np.zeros(size + 1, np.int32)
    mark[starts] += 1
    mark[starts + length] -= 1
    return np.cumsum(mark[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of every row of ``docs``; ``text`` is what is left."""
    spark = docs.sparkSession
    if length < V:
        raise ValueError(f"length must be at least {V}")
    n = parallelism(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row_key, text_key = F.xxhash64(F.col("doc_id").cast("string"), text), F.xxhash64(text)
    light = docs.select(row_key.alias("row_key"), text_key.alias("text_key"),
                        F.md5(text.cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("n"))
    total = light.agg(F.sum("n")).first()[0] or 0
    blocks = max(3 * n, -(-total // block_bytes))
    sample_buckets = max(1, n // 3, total * len(cover()) // V // BUCKET_ENTRIES)
    suffix_buckets = max(1, n // 3, total // (4 * BUCKET_ENTRIES))

    def block_of(key):
        return F.pmod(F.xxhash64(key), F.lit(blocks))

    # exact copies: the first row of each text that repeats is status 1, further rows status 2
    copies = checkpointed(light.where(F.col("n") >= length).groupBy("digest", "n")
                          .agg(F.count(F.lit(1)).alias("c"), F.min("row_key").alias("first")).where("c > 1"))
    status = (light.where(F.col("n") >= length).join(copies, ["digest", "n"])
              .select(block_of(F.col("row_key")).alias("block"), F.lit(STATUS).alias("kind"),
                      F.when(F.col("row_key") == F.col("first"), 1).otherwise(2).cast("long").alias("bucket"),
                      "row_key", "text_key", F.lit(b"").alias("tied")))
    status = checkpointed(status)
    texts = (docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text.alias("text"),
                         row_key.alias("row_key"), text_key.alias("text_key"))
             .withColumn("block", block_of(F.col("row_key"))).repartition(n, "block"))

    def with_notes(notes: DataFrame, fn, schema: str) -> DataFrame:
        return texts.groupBy("block").cogroup(notes.repartition(n, "block").groupBy("block")).applyInPandas(fn, schema)

    def taking_part(rows: pd.DataFrame, notes: pd.DataFrame) -> tuple[list, list[np.ndarray]]:
        """All rows (doc_id, bytes, status), and the pieces of those whose suffixes are sorted."""
        every = list(_text_rows(rows, _status(notes)))
        return every, [part for _, data, state in every if state < 2 for part in pieces(data, length, piece_bytes)]

    def send_samples(key: tuple, rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        return sample_entries(taking_part(rows, notes)[1], length, sample_buckets)[0].rows(int(key[0]))

    def suffixes(own: list[np.ndarray], notes: pd.DataFrame) -> tuple[Entries, list[np.ndarray]]:
        samples, places = sample_entries(own, length, sample_buckets)
        return suffix_entries(own, places, samples.tied(notes, SAMPLES), length, suffix_buckets)

    def send_suffixes(key: tuple, rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        return suffixes(taking_part(rows, notes)[1], notes)[0].rows(int(key[0]))

    def cut(key: tuple, rows: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        every, own = taking_part(rows, notes)
        entries, places = suffixes(own, notes)
        tied = entries.tied(notes, SUFFIXES)
        starts = iter([p[flag] for p, flag in zip(places, np.split(tied, np.cumsum([len(p) for p in places])[:-1]))] if own else [])
        out = []
        for doc_id, data, state in every:
            size = len(data)
            gone = np.zeros(size, bool)
            if state < 2:
                own_starts = [at + next(starts) for at in range(0, size - length + 1, piece_bytes)]
                if own_starts:
                    gone = covered(size, np.concatenate(own_starts), length)
            if state:
                gone[:] = True
            edges = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
            left = data[~gone].tobytes()
            out.append((doc_id, size, int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(left).hexdigest(), left.decode(errors="replace")))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])
        return frame.astype({"doc_id": "Int64"})

    sample_ties = (with_notes(status, send_samples, ENTRIES).groupBy("bucket")
                   .applyInPandas(_sort_bucket(SAMPLES, np.uint32, np.uint8), NOTES))
    known = status.unionByName(sample_ties)
    suffix_ties = (with_notes(known, send_suffixes, ENTRIES).groupBy("bucket")
                   .applyInPandas(_sort_bucket(SUFFIXES, np.uint64, np.uint16), NOTES))
    return with_notes(known.unionByName(suffix_ties), cut, RESULT)
