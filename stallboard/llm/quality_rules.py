"""Operator 4: quality rules with distribution divergence from language references.

Base rules: at least ``MIN_WORDS`` words, and at most ``MAX_REPEAT`` per cent of the words inside
5-word windows that occur twice or more in the text.

Divergence: for every language the whole corpus gives two reference histograms: characters by
class (lower-case letter, upper-case letter, other letter or mark, digit, white space, sentence
punctuation, other symbol) and its common words (each of at least ``COMMON_SHARE`` of the
language's words, all other words together in one cell). A document's histograms are compared
with its language's references by the Jensen-Shannon distance (base 2, 0 to 1); a document is
kept if both stay below their limits. The distances of a short text say little, so below
``MIN_CHARS`` characters or ``MIN_HISTOGRAM_WORDS`` words the respective test is passed.

The common words are found exactly: a Misra-Gries summary per task and a two-level merge keep
every word that can reach the share (its size is bounded by 1 / share, not by the corpus), a
second pass counts those words over all documents, and the reference takes those that do reach it.

A language with fewer than ``MIN_REFERENCE_DOCS`` documents or ``MIN_REFERENCE_WORDS`` words is no reference: a
document would mostly be compared with itself.

Nulls and empties: null texts have no words and fail the base rules. A document with a null or
unknown language, or one without reference, is compared with every reference and takes the smallest distances;
with no reference at all the divergence tests are passed. Repeated rows count as often as they occur.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallboard.llm.common import checkpointed

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT = 20
COMMON_SHARE = 0.002
MIN_CHARS = 150
MIN_HISTOGRAM_WORDS = 40
MIN_REFERENCE_DOCS = 10
MIN_REFERENCE_WORDS = 1000
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.45
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\W\d_]+|[^\w\s]+")
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
SENTENCE_MARKS = ".,;:!?'\"()-"
CLASSES = 7
KEPT_COUNTERS = int(2 / COMMON_SHARE)
LEVEL_ONE = 512


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Class of every code point (fixed meaning: see the module's head)."""
    table = np.full(0x110000, 6, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind == "Ll":
            table[c] = 0
        elif kind == "Lu":
            table[c] = 1
        elif kind[0] in "LM":
            table[c] = 2
        elif kind[0] == "N":
            table[c] = 3
        elif kind[0] == "Z" or 9 <= c <= 13:
            table[c] = 4
    for ch in SENTENCE_MARKS:
        table[ord(ch)] = 5
    return table


def char_histogram(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(_class_table()[points], minlength=CLASSES)


def letter_words(text: str) -> list[str]:
    """Words of the histograms: runs of letters in lower case, and runs of punctuation or symbols."""
    return LETTERS.findall(text.lower())


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    # equal windows have equal codes: most texts have none and are done
    code = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = code[:n].copy()
    for k in range(1, window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + code[k:k + n]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    # names of ever longer runs, exact: 2, 4 and 5 words
    code = ids[:-1] * len(numbers) + ids[1:]
    _, two = np.unique(code, return_inverse=True)
    _, four = np.unique(two[:-2] * (int(two.max()) + 1) + two[2:], return_inverse=True)
    _, name, count = np.unique(four[:n] * len(numbers) + ids[4:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[name] > 1)
    mark = np.zeros(len(words) + 1, np.int64)
    mark[again] += 1
    mark[again + window] -= 1
    return int((np.cumsum(mark[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def base_figures(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of one text."""
    text = text or ""
    words = WORD.findall(text)
    repeated = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT * len(words)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, failed


def summarize(counts: Counter, keep: int = KEPT_COUNTERS) -> Counter:
    """Misra-Gries: at most ``keep`` counters; a word above total / keep never goes."""
    if len(counts) <= keep:
        return counts
    cut = sorted(counts.values(), reverse=True)[keep]
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


@dataclass
class References:
    """Per language: character class shares, common words with their cell, and word cell shares."""
    chars: dict[str, np.ndarray]
    cells: dict[str, dict[str, int]]
    words: dict[str, np.ndarray]


def fit(docs: DataFrame) -> References:
    """References of every language in ``docs`` with enough documents and words, counted over all its documents."""
    spark = docs.sparkSession
    source = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: dict[str, Counter] = {}
        chars: dict[str, np.ndarray] = {}
        docs_of: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chars[lang] = chars.get(lang, 0) + char_histogram(text)
                docs_of[lang] += 1
                own = summary.setdefault(lang, Counter())
                own.update(letter_words(text))
                if len(own) > 200_000:
                    summary[lang] = summarize(own)
        rows = [(lang, w, n) for lang, own in summary.items() for w, n in summarize(own).items()]
        rows += [(lang, None, int(n) * CLASSES + k) for lang, c in chars.items() for k, n in enumerate(c)]
        rows += [(lang, "", n) for lang, n in docs_of.items()]  # documents, under the empty word
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        for word, n in zip(rows["word"], rows["n"]):
            total[word] += int(n)
            if len(total) > 50 * KEPT_COUNTERS:
                total = summarize(total)
        total = summarize(total)
        return pd.DataFrame({"lang": key[0], "part": 0, "word": list(total), "n": list(total.values())})

    schema = "lang string, part int, word string, n long"
    found = source.mapInArrow(first_pass, "lang string, word string, n long").withColumn("part", F.spark_partition_id() % LEVEL_ONE)
    found = checkpointed(found)
    chars: dict[str, np.ndarray] = {}
    cells = found.where("word IS NULL").select("lang", (F.col("n") % CLASSES).cast("int").alias("k"), F.floor(F.col("n") / CLASSES).alias("n"))
    for r in cells.groupBy("lang", "k").agg(F.sum("n").alias("n")).collect():  # languages x classes rows
        chars.setdefault(r.lang, np.zeros(CLASSES))[r.k] = r.n
    documents = {r.lang: r.n for r in found.where("word = ''").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    merged = (found.where("word <> ''").select("lang", "part", "word", "n")
              .groupBy("lang", "part").applyInPandas(merge, schema).groupBy("lang").applyInPandas(merge, schema))
    candidates: dict[str, set[str]] = {}
    for r in merged.collect():  # at most KEPT_COUNTERS words per language
        candidates.setdefault(r.lang, set()).add(r.word)
    shared = spark.sparkContext.broadcast(candidates)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = count.setdefault(lang, Counter())
                words = letter_words(text)
                own.update(words)
                own[None] += len(words)
            for lang, own in count.items():
                known = shared.value.get(lang, ())
                count[lang] = Counter({w: n for w, n in own.items() if w is None or w in known})
        rows = [(lang, w, n) for lang, own in count.items() for w, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    exact: dict[str, dict] = {}
    for r in (source.mapInArrow(second_pass, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()):
        exact.setdefault(r.lang, {})[r.word] = r.n  # the candidates' counts
    out = References({}, {}, {})
    for lang, c in chars.items():
        total = exact.get(lang, {}).pop(None, 0)
        if documents[lang] < MIN_REFERENCE_DOCS or total < MIN_REFERENCE_WORDS:
            continue
        common = sorted((w for w, n in exact.get(lang, {}).items() if n >= COMMON_SHARE * total), key=lambda w: (-exact[lang][w], w))
        share = np.array([exact[lang][w] for w in common] + [0.0])
        share[-1] = total - share.sum()
        out.chars[lang] = c / max(c.sum(), 1)
        out.cells[lang] = {w: k for k, w in enumerate(common)}
        out.words[lang] = share / max(total, 1)
    return out


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits: 0 for equal, 1 for disjoint distributions."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(gain / 2, 0)))


def distances(text: str, lang: str | None, refs: References) -> tuple[float, float]:
    """Distances (characters, words) of a text from its language, 0 where it is too short to tell."""
    if lang not in refs.chars:
        own = [distances(text, one, refs) for one in refs.chars]
        return min((d[0] for d in own), default=0.0), min((d[1] for d in own), default=0.0)
    chars = words = 0.0
    histogram = char_histogram(text)
    if histogram.sum() >= MIN_CHARS:
        chars = jensen_shannon(histogram / histogram.sum(), refs.chars[lang])
    found = letter_words(text)
    if len(found) >= MIN_HISTOGRAM_WORDS:
        cells, size = refs.cells[lang], len(refs.words[lang])
        get = cells.get
        own = np.bincount([get(w, size - 1) for w in found], minlength=size)
        words = jensen_shannon(own / len(found), refs.words[lang])
    return chars, words


RESULT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, char_distance double, word_distance double")


def judge(docs: DataFrame, refs: References, max_chars: float = MAX_CHAR_DISTANCE, max_words: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Figures, distances and verdict of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                figures = base_figures(text)
                far = distances(text or "", lang, shared.value)
                rows.append((doc_id, *figures, not figures[-1] and far[0] <= max_chars and far[1] <= max_words, *far))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return (docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
            .mapInArrow(run, RESULT))
