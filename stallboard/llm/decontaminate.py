r"""Operator 2: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Test items and documents are cut into lower-case words (``\w+``). The score of a pair is the best
local alignment (Smith-Waterman, match 1, mismatch and gap -1) over the item's number of words, so
that copies with replaced, dropped or inserted words still score. A pair is a leak from ``MIN_SCORE`` on.

Seeds that decide, without loss. An alignment of m matches and e errors has at most e + 1 runs of
matches, so a score of s = m - e leaves at least s - 1 of the item's L - 1 pairs of neighbouring words
intact. Any L - s + 1 of the pairs therefore hold an intact one. An item's seeds are its L - s + 1 rarest
pairs, by the number of documents of the whole corpus that hold them; its common pairs are never looked up. A
document that shares a seed and at least s - 1 of the item's pairs is a candidate. Candidates are aligned
where s - 1 shared pairs lie within a band of diagonals (place in the document less place in the item) of
the width that e errors allow.

One pass over the corpus writes, per document, the 64-bit codes of its word pairs that may belong to an
item. A table of ``TABLE_BITS`` bits, the same for any benchmark, leaves most others out; the joins with
the items' pairs are exact in the codes. The frequencies, the join of seeds with documents and the
counting are Spark joins and aggregates, so neither the items nor the candidates pass through the driver. A common pair
is looked up only if it is among an item's rarest; Spark splits such a key of a join over tasks.

Short items: those with fewer than ``MIN_WORDS`` words leak only as a whole, every word in order (their score is
1); items of one or two words only into documents that consist of them. Items without words never match.

Nulls and empties: null texts have no words. Repeated document rows give repeated results, repeated items
one; rows with a null doc_id are checked like others. Empty tables: no leaks, and every document is kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallboard.llm.common import byte_slices, checkpointed, written

MIN_WORDS = 8
MIN_SCORE = 0.5
TABLE_BITS = 1 << 24
#: Bits of one value of Spark's bitmap aggregate.
BITMAP = 1 << 15
#: Parts in which the candidates of one document are aligned.
CHUNKS = 16
SLICE_BYTES = 1 << 20
WORD = re.compile(r"\w+")
ITEMS = "item_key long, item_id long, words string, n_words int, need int, pairs array<long>"
LEAKS = "doc_id long, item_id long, score double, first_word long, last_word long"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def needed_score(n_words: int, min_score: float) -> int:
    """Least alignment score of a leak: the whole item if it is short, two words at least."""
    return n_words if n_words < MIN_WORDS else max(2, math.ceil(min_score * n_words - 1e-9))


def pair_codes(found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of all pairs of neighbouring words, and of the whole of a text with one or two words."""
    lens = np.fromiter(map(len, found), np.int64, len(found))
    coded = pa.array(chain.from_iterable(found), pa.large_string(), size=int(lens.sum())).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    known = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else known
    row = np.repeat(np.arange(len(found)), lens)
    mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(0x632BE59BD9B4E019))
    mixed ^= mixed >> np.uint64(29)
    inside = row[:-1] == row[1:]
    short = np.flatnonzero((lens > 0) & (lens < 3))
    first = (np.cumsum(lens) - lens)[short]
    whole = ~(h[first] * np.uint64(3) + np.where(lens[short] == 2, h[np.minimum(first + 1, max(len(h) - 1, 0))], np.uint64(0)))
    return np.concatenate((mixed[inside], whole)).view(np.int64), np.concatenate((row[:-1][inside], short))


def item_table(benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per different item with words: its words, the score that it needs, and the codes of its pairs in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            found = [words(t) for t in batch.column(2).to_pylist()]
            code, row = pair_codes(found)
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(len(found) + 1))
            # a text of two words has a pair too, but only its whole counts
            lists = [code[order][a:b][-1:] if len(w) < 3 else code[order][a:b] for w, a, b in zip(found, cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([" ".join(w) for w in found], pa.string()),
                 pa.array([len(w) for w in found], pa.int32()), pa.array([needed_score(len(w), min_score) for w in found], pa.int32()),
                 pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))], ["item_key", "item_id", "words", "n_words", "need", "pairs"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    return items.select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", "text").mapInArrow(run, ITEMS).where("n_words > 0")


def _bit(pair: Column) -> Column:
    return F.pmod(pair, F.lit(TABLE_BITS))


def bit_table(pairs: DataFrame) -> np.ndarray:
    """``TABLE_BITS`` flags, set where a pair's code falls; at most 2 MB come to the driver."""
    bit = _bit(F.col("pair")) + 1
    rows = pairs.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(TABLE_BITS, bool)
    for r in rows:
        out[(r.k - 1) * BITMAP:r.k * BITMAP] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    return out


def text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def document_pairs(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(text_key, pair, n): the different pairs of every text that may belong to an item, and the rows with that text.

    Copies of a text are one row per task and pair before they are shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(shared.value).view(bool)
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            code, row = pair_codes([words(t) for t in batch.column(1).to_pylist()])
            hit = flags[code & (TABLE_BITS - 1)]
            code, row = code[hit], row[hit]
            order = np.lexsort((code, row))
            code, row = code[order], row[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new])), pa.array(code[new])], ["text_key", "pair"])

    return (docs.where(F.col("text").isNotNull()).select(text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "text_key long, pair long").groupBy("text_key", "pair").agg(F.count(F.lit(1)).alias("n")))


def seeds(items: DataFrame, held: DataFrame) -> DataFrame:
    """(item_key, pair): the rarest pairs of each item, as many as no leak can do without; ``held`` are the documents' pairs."""
    frequency = held.groupBy("pair").agg(F.sum("n").alias("df"))
    places = items.select("item_key", F.greatest(F.col("n_words") - F.col("need") + 1, F.lit(1)).alias("many"), F.posexplode("pairs").alias("place", "pair"))
    rarest = Window.partitionBy("item_key").orderBy(F.coalesce("df", F.lit(0)), "place")
    return (places.join(frequency, "pair", "left").withColumn("k", F.row_number().over(rarest)).where("k <= many")
            .where("df IS NOT NULL").select("item_key", "pair").distinct())


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(text_key, item_key) of the texts that share a seed and enough pairs with an item."""
    pairs = items.select(F.explode("pairs").alias("pair"))
    held = checkpointed(document_pairs(docs, bit_table(pairs)))
    meet = written(held.join(seeds(items, held), "pair").select("text_key", "item_key").distinct(), "leak-candidates")
    # pairs of the candidates' items that their text holds, place by place
    places = meet.join(items.select("item_key", F.greatest(F.when(F.col("n_words") < 3, 1).otherwise(F.col("need") - 1), F.lit(1)).alias("least"),
                                    F.posexplode("pairs").alias("place", "pair")), "item_key")
    return (places.join(held, ["text_key", "pair"]).groupBy("text_key", "item_key", "least").agg(F.count(F.lit(1)).alias("n"))
            .where("n >= least").select("text_key", "item_key"))


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score (match 1, mismatch -1, gap -1) and its first and last place in ``window``."""
    width = len(window)
    steps = np.arange(width + 1)
    above = np.zeros(width + 1, np.int64)
    begun = steps.copy()
    best, first, last = 0, 0, -1
    for word in item:
        diagonal = above[:-1] + np.where(window == word, 1, -1)
        up = above[1:] - 1
        row = np.zeros(width + 1, np.int64)
        row[1:] = np.maximum(np.maximum(diagonal, up), 0)
        start = steps.copy()
        start[1:] = np.where(row[1:] == 0, steps[1:], np.where(diagonal >= up, begun[:-1], begun[1:]))
        # gaps along the window: the best earlier cell less its distance
        reach = row + steps
        top = np.maximum.accumulate(reach)
        origin = np.maximum.accumulate(np.where(reach == top, steps, 0))
        start, row = start[origin], top - steps
        k = int(row.argmax())
        if row[k] > best:
            best, first, last = int(row[k]), int(start[k]), k - 1
        above, begun = row, start
    return best, first, last


def _aligned(item: np.ndarray, ids: np.ndarray, starts: np.ndarray, slack: int) -> tuple[int, int, int]:
    """Best alignment of the item with the words around the sorted ``starts``, ``slack`` more on both sides."""
    best = (0, 0, -1)
    for group in np.split(starts, np.flatnonzero(np.diff(starts) > len(item)) + 1):
        a, b = max(0, int(group[0]) - slack), min(len(ids), int(group[-1]) + len(item) + slack)
        score, first, last = smith_waterman(item, ids[a:b])
        if score > best[0]:
            best = (score, a + first, a + last)
    return best


def _band_starts(item_pairs: np.ndarray, found: np.ndarray, needed: int, width: int) -> np.ndarray | None:
    """Diagonals from which on ``needed`` shared word pairs lie at most ``width`` diagonals apart; None: any place."""
    if needed <= 0:
        return None
    order = np.argsort(item_pairs, kind="stable")
    low, high = (np.searchsorted(item_pairs[order], found, side) for side in ("left", "right"))
    many = high - low
    total = int(many.sum())
    if total > 64 * (len(found) + len(item_pairs)):  # one word pair over and over in both
        return None
    at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(total)
    diagonal = np.sort(np.repeat(np.arange(len(found)), many) - order[at])
    if total < needed:
        return diagonal[:0]
    begins = diagonal[:total - needed + 1]
    return begins[diagonal[needed - 1:] - begins <= width]


def text_leaks(text: str | None, items: list[tuple[int, str, int]]) -> list[tuple[int, float, int, int]]:
    """(item_id, score, first word, last word) of the given (item_id, words, needed score) that leak into one text, best place each."""
    numbers: dict[str, int] = {}
    wanted = [(item_id, np.array([numbers.setdefault(w, len(numbers)) for w in own.split(" ")], np.int64), need) for item_id, own, need in items]
    get, size = numbers.get, len(numbers)
    ids = np.array([get(w, -1) for w in words(text)], np.int64)
    found = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * size + ids[1:], -1)
    out = []
    for item_id, item, need in wanted:
        n = len(item)
        if n < 3 and not np.array_equal(ids, item):
            continue
        starts = _band_starts(item[:-1] * size + item[1:], found, need - 1, n - need)
        if starts is not None and not len(starts):
            continue
        score, first, last = smith_waterman(item, ids) if starts is None else _aligned(item, ids, starts, n - need + 2)
        if score >= need:
            out.append((item_id, score / n, first, last))
    return out


def _with_items(docs: DataFrame, benchmark: DataFrame, min_score: float) -> DataFrame:
    """``docs`` (with their ``text``) that are candidates, each with a list ``items`` of (item_id, words, need)."""
    items = checkpointed(item_table(benchmark, min_score))
    found = candidates(docs, items).join(items.select("item_key", "item_id", "words", "need"), "item_key")
    lists = (found.groupBy("text_key", F.pmod("item_key", F.lit(CHUNKS)).alias("chunk"))
             .agg(F.collect_list(F.struct("item_id", "words", "need")).alias("items")).drop("chunk"))
    return docs.withColumn("text_key", text_key()).join(written(lists, "leak-items"), "text_key").drop("text_key")


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): one row per document row and leaking item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d.as_py(), *leak) for d, t, i in zip(*batch.columns)
                    for leak in text_leaks(t.as_py(), [(x["item_id"], x["words"], x["need"]) for x in i.as_py()])]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                             ["doc_id", "item_id", "score", "first_word", "last_word"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_items(own, benchmark, min_score).select("doc_id", "text", "items").mapInArrow(run, LEAKS)


def remove_leaking(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents, with all their columns, into which no test item leaks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [bool(text_leaks(t.as_py(), [(x["item_id"], x["words"], x["need"]) for x in i.as_py()])) for t, i in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], ["name"])

    # texts are told apart by 128 bits here: a clean one must not go for a chance tie
    name = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("name")
    texts = docs.where(F.col("text").isNotNull()).select(name, F.col("text").cast("string").alias("text"))
    gone = _with_items(texts, benchmark, min_score).select("name", "text", "items").mapInArrow(run, "name string").distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), name)
    return rows.join(written(gone, "leaking-texts"), "name", "left_anti").select("row.*")
