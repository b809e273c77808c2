"""Operator 12: how far the sources of a language diverge, by count-cell ranking.

Terms are runs of letters (ASCII ones lower-cased) and non-ASCII characters. A language keeps
the V terms that occur in at least ``min_docs`` of its documents. With N occurrences of kept
terms in a group (a language and source) or in a language, a kept term with ``count`` of them has
p = 1 + floor(SCALE (count + 2) / (N + 2 V)); two such numbers diverge by
f = floor((p - q)^2 / (p + q)). All arithmetic is on integers.

Part ``term`` ranks the terms that a group uses more than its language. All terms with one
(group count, language count) have one f, so terms are grouped into such cells, f is evaluated
once per cell, cells of equal value are merged, and the cells are ranked by value with their
cumulative multiplicity. Only the cells in which the first ``ranks`` terms lie are expanded to
terms, in UTF-8 order. Part ``pair`` sums f over all kept terms for every other source of the
language: V times the value of two absent terms, plus, per cell of a group's counts, what its own
terms change against the other's absent term, plus a correction for the terms that both hold,
summed from each term's short list of sources.

Counts are combined in the tasks before they are shuffled; a term that stands in every document is one row
per task and source. Sums of counts must stay below 9 10^15.

Nulls and empties: null texts, languages and sources count as ''. A group without terms and a
language without kept terms (V = 0: all pair values 0) keep their rows of part ``pair``. A
language with one source has none. Repeated rows are separate documents. An empty table gives an
empty result. Columns of the documents other than text, lang and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallboard.llm.common import byte_slices, checkpointed, packed_words, utf8, word_table

MIN_DOCS = 10
RANKS = 10
SCALE_STEPS = 3  # p is found in three steps of three decimal digits: SCALE is 1000 ** 3
SLICE_BYTES = 4 << 20
#: Pairs of sources that a task holds at once.
PAIRS = 1 << 21
#: Tasks over which the count cells of one language are dealt, at least.
SALTS = 32
WORD = word_table("".join(c for c in map(chr, range(128)) if not c.isalpha()))
COUNTS = "lang string, source string, term string, n long, docs long"


def _batch_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row per (lang, source, term) of the batch, and one with a null term per (lang, source)."""
    langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    width = len(sources.dictionary)
    own = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width + sources.indices.to_numpy(zero_copy_only=False)
    groups, group = np.unique(own, return_inverse=True)
    words, row = packed_words(*utf8(batch.column("text")), WORD)
    coded = pa.Array.from_buffers(pa.large_string(), len(words), words.buffers()).dictionary_encode()
    many = max(len(coded.dictionary), 1)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # occurrences per (document, term), then per (group, term)
    in_docs, times = np.unique(row * many + code, return_counts=True)
    keys, place, docs = np.unique(group[in_docs // many] * many + in_docs % many, return_inverse=True, return_counts=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, times)
    of = groups[np.concatenate((keys // many, np.arange(len(groups))))]
    terms = pa.concat_arrays([coded.dictionary.take(pa.array(keys % many)), pa.nulls(len(groups), pa.large_string())])
    none = np.zeros(len(groups), np.int64)
    return pa.RecordBatch.from_arrays(
        [langs.dictionary.take(pa.array(of // width)).cast(pa.string()), sources.dictionary.take(pa.array(of % width)).cast(pa.string()),
         terms.cast(pa.string()), pa.array(np.concatenate((total, none))), pa.array(np.concatenate((docs, none)))],
        ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term, and a row with a null term per group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            yield _batch_counts(batch)

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return (texts.mapInArrow(run, COUNTS).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1000^3 (count + 2) / (total + 2 kept)), by long division in steps that fit 64 bits."""
    divisor = total + 2 * kept
    rest, out = count + 2, F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        scaled = rest * 1000
        digit = F.call_function("div", scaled, divisor)
        out = out * 1000 + digit
        rest = scaled - digit * divisor
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _kept(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, lang_n, uses): kept terms with their occurrences and their list of (source, n)."""
    return (counts.where("term IS NOT NULL").groupBy("lang", "term")
            .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("d"), F.collect_list(F.struct("source", "n")).alias("uses"))
            .where(F.col("d") >= min_docs).drop("d"))


def _joint(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): over the terms that both hold, f(p, q) - f(p, z) - f(y, q) + f(y, z).

    ``rows`` are (lang, uses) with ``uses`` the term's list of (source, p, y): its share there and the share of
    an absent term. Sums are combined per batch; a task holds ``PAIRS`` pairs of sources at once."""
    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // (p + q)

    def sums(langs: pa.Array, uses: pa.Array) -> pa.RecordBatch:
        bounds = uses.offsets.to_numpy().astype(np.int64)
        size, first = np.diff(bounds), bounds[:-1] - bounds[0]
        flat = uses.flatten()
        names = flat.field("source").dictionary_encode()
        who = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        p, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "y"))
        width = max(len(names.dictionary), 1)
        lang_names = langs.dictionary_encode()
        lang = lang_names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        term = np.repeat(np.arange(len(size)), size)
        left = np.repeat(np.arange(len(term)), size[term])
        within = np.arange(len(left)) - np.repeat(np.cumsum(size[term]) - size[term], size[term])
        right = first[term[left]] + within
        other = left != right
        left, right = left[other], right[other]
        value = f(p[left], p[right]) - f(p[left], y[right]) - f(y[left], p[right]) + f(y[left], y[right])
        key, place = np.unique((lang[term[left]] * width + who[left]) * width + who[right], return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, place, value)
        return pa.RecordBatch.from_arrays(
            [lang_names.dictionary.take(pa.array(key // width // width)).cast(pa.string()), names.dictionary.take(pa.array(key // width % width)).cast(pa.string()),
             names.dictionary.take(pa.array(key % width)).cast(pa.string()), pa.array(total)], ["lang", "source", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64) ** 2
            upto, at = np.cumsum(work), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                yield sums(batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at))
                at = end

    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def _pairs(groups: DataFrame, uses: DataFrame) -> DataFrame:
    """Part ``pair``: every other source of the language with its summed divergence."""
    absent = groups.select("lang", "source", "many", F.when(F.col("many") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("many")))
                           .otherwise(1).alias("y"))
    other = absent.select("lang", F.col("source").alias("item"), F.col("y").alias("z"))
    both = absent.join(other, "lang").where("source <> item")  # the result's own rows
    base = both.select("lang", "source", "item", (F.col("many") * divergence(F.col("y"), F.col("z"))).alias("value"))
    cells = uses.groupBy("lang", "source", "p", "y").agg(F.count(F.lit(1)).alias("m"))
    # a language may hold most cells: they are dealt by a salt, and the list of its sources goes to each
    salted = cells.withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int"))
    every = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = (salted.join(every, ["lang", "salt"]).where("source <> item")
           .select("lang", "source", "item", (F.col("m") * (divergence(F.col("p"), F.col("z")) - divergence(F.col("y"), F.col("z")))).alias("value"))
           .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    turned = own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    joint = _joint(uses.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "y")).alias("uses")).select("lang", "uses"))
    sums = (base.unionByName(own).unionByName(turned).unionByName(joint)
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))


def _terms(uses: DataFrame, ranks: int) -> DataFrame:
    """Part ``term``: the first ``ranks`` terms of every group, from ranked count cells."""
    group = ["lang", "source"]
    cells = uses.groupBy(*group, "n", "lang_n", "p", "q").agg(F.count(F.lit(1)).alias("m")).where("p > q")
    cells = cells.withColumn("value", divergence(F.col("p"), F.col("q")))
    by_value = Window.partitionBy(*group).orderBy(F.desc("value"))
    merged = cells.groupBy(*group, "value").agg(F.sum("m").alias("m"))
    # every value has a term, so the first values suffice; they lie in few rows per group
    first = merged.withColumn("k", F.row_number().over(by_value)).where(F.col("k") <= ranks)
    before = F.coalesce(F.sum("m").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = first.withColumn("before", before).where(F.col("before") < ranks).select(*group, "value")
    open_cells = cells.join(chosen, [*group, "value"]).select(*group, "n", "lang_n", "value")
    terms = uses.select(*group, "n", "lang_n", "term").join(open_cells, [*group, "n", "lang_n"])
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "term"))
    return (terms.withColumn("rank", place).where(F.col("rank") <= ranks)
            .select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups of ``docs``."""
    counts = checkpointed(term_counts(docs))
    kept = checkpointed(_kept(counts, min_docs))
    flat = kept.select("lang", "term", "lang_n", F.inline("uses"))
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("many"))
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = counts.where("term IS NULL").select("lang", "source")
    groups = checkpointed(named.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "many"]))
    uses = checkpointed(flat.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "lang_n", share(F.col("n"), F.col("total"), F.col("many")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("many")).alias("q"),
        share(F.lit(0).cast("long"), F.col("total"), F.col("many")).alias("y")))
    return _pairs(groups, uses).unionByName(_terms(uses, ranks))
