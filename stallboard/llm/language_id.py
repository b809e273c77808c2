"""Operator 3: language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes through one gated recurrent layer per direction and labels every
byte position with language probabilities; a document's probabilities are the mean over all
its positions. It is trained in numpy by backpropagation through time on at most
``train_windows`` windows of ``train_chars`` characters, the same number for every language, drawn from
hash-chosen places of the documents (the draws with the smallest hashes, whatever the corpus size). Prediction reads
whole texts, cut into windows of ``WINDOW`` bytes; the last window of a longer text is its last ``WINDOW`` bytes, of
which only the positions not yet labelled count.

Nulls and empties: a null text or one without a letter gets ``und`` with score 0; rows with a
null lang or doc_id never train; with no training row every text is ``und``. Ties go to the
alphabetically first language. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallboard.llm.common import byte_slices, hash_bound, utf8

HIDDEN = 6
WINDOW = 256
BATCH = 1024
TRAIN_WINDOWS = 3000
TRAIN_CHARS = 64
DRAWS = 4
STEPS = 150
UNDETERMINED = "und"
MIN_SCORE = 0.3
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """Languages and weights, both directions stacked in front: input tables ``w`` (2, 3H, 256) with
    rows update gate, reset gate, candidate; recurrent ``u`` (2, 3H, H); candidate bias ``r``
    (2, H, 1); output ``v`` (C, 2H) and ``c`` (C, 1)."""
    langs: list[str]
    weights: dict[str, np.ndarray]


def held_out() -> Column:
    """The documents that never train: crc32 of the doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _softsign(x: np.ndarray) -> None:
    """x / (1 + |x|) in place: the squashing function of gates and candidate."""
    below = np.abs(x)
    below += 1
    x /= below


def _gru(x: np.ndarray, p: dict[str, np.ndarray], mask: np.ndarray | None = None,
         keep: bool = False) -> tuple[np.ndarray, list]:
    """States (T, 2, H, B) of bytes ``x`` (T, B); the backward direction reads ``x`` from its end.

    ``mask`` (T, B) is 0 where the text has not begun (padding in front): the forward state
    stays 0 there, and the backward states there are not used. ``keep`` saves what
    backpropagation needs."""
    w, u, r = p["w"], p["u"], p["r"]
    steps, width = x.shape
    size = u.shape[2]
    index = x.astype(np.intp)
    h = np.zeros((2, size, width), np.float32)
    out = np.empty((steps, 2, size, width), np.float32)
    a, g = np.empty((2, 3 * size, width), np.float32), np.empty((2, 3 * size, width), np.float32)
    saved = []
    for t in range(steps):
        np.take(w[0], index[t], axis=1, out=a[0], mode="clip")
        np.take(w[1], index[steps - 1 - t], axis=1, out=a[1], mode="clip")
        np.matmul(u, h, out=g)
        gates, inner = a[:, :2 * size], g[:, 2 * size:]
        gates += g[:, :2 * size]
        _softsign(gates)
        gates *= 0.5
        gates += 0.5
        inner += r
        n = inner * gates[:, size:]
        n += a[:, 2 * size:]
        _softsign(n)
        if keep:
            saved.append((h, gates.copy(), inner.copy(), n))
        h = np.subtract(h, n, out=out[t])
        h *= gates[:, :size]
        h += n
        if mask is not None:
            h[0] *= mask[t]
    return out, saved


def _gru_back(x: np.ndarray, p: dict[str, np.ndarray], saved: list, dh_out: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of input tables, recurrent weights and candidate bias, through time."""
    u = p["u"]
    size, steps = u.shape[2], len(saved)
    dw = np.zeros((2, 256, 3 * size), np.float32)
    du, dr_bias = np.zeros_like(u), np.zeros_like(p["r"])
    dh = np.zeros_like(saved[0][0])
    for t in range(steps - 1, -1, -1):
        h, gates, inner, n = saved[t]
        z, r = gates[:, :size], gates[:, size:]
        dh = dh + dh_out[t]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        # a gate is (1 + s) / 2 with s a softsign: half its slope
        dz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dn * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        da = np.concatenate((dz, dr, dn), axis=1)
        dg = np.concatenate((dz, dr, dn * r), axis=1)
        np.add.at(dw[0], x[t], da[0].T)
        np.add.at(dw[1], x[steps - 1 - t], da[1].T)
        du += dg @ h.transpose(0, 2, 1)
        dr_bias += dg[:, 2 * size:].sum(axis=2, keepdims=True)
        dh = dh * z + u.transpose(0, 2, 1) @ dg
    return {"w": dw.transpose(0, 2, 1), "u": du, "r": dr_bias}


def _logits(out: np.ndarray, p: dict[str, np.ndarray], at: int = 0, end: int | None = None) -> np.ndarray:
    """(T, C, B) scores of the positions ``at`` to ``end`` from the two directions' states."""
    size = p["u"].shape[2]
    return p["v"][:, :size] @ out[at:end, 0] + p["v"][:, size:] @ out[::-1, 1][at:end] + p["c"]


def train(windows: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS,
          batch: int = 250, rate: float = 0.02, seed: int = 7) -> Model:
    """Fits the network to labelled windows; languages weigh equally however often they occur."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    width = max((len(w) for w in windows), default=0)
    # shorter windows are repeated to the common width, so languages of short texts train too
    rows = [((w * (width // len(w) + 1))[:width], langs.index(y)) for w, y in zip(windows, labels) if w]
    if not rows:
        return Model([], {})
    xs = np.frombuffer(b"".join(w for w, _ in rows), np.uint8).reshape(len(rows), width)
    ys = np.array([y for _, y in rows])
    share = len(ys) / (len(langs) * np.maximum(np.bincount(ys, minlength=len(langs)), 1))
    p = {"v": rng.normal(0, 0.3, (len(langs), 2 * hidden)), "c": np.zeros((len(langs), 1)), "w": rng.normal(0, 0.7, (2, 3 * hidden, 256)),
         "u": rng.normal(0, 0.3, (2, 3 * hidden, hidden)), "r": np.zeros((2, hidden, 1))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    while step < steps:
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            own = order[at:at + batch]
            x = np.ascontiguousarray(xs[own].T)
            out, saved = _gru(x, p, keep=True)
            d = _logits(out, p)
            d -= d.max(axis=1, keepdims=True)
            np.exp(d, out=d)
            d /= d.sum(axis=1, keepdims=True)
            d[:, ys[own], np.arange(len(own))] -= 1
            d *= share[ys[own]].astype(np.float32) / (len(own) * width)
            both = np.concatenate((out[:, 0], out[::-1, 1]), axis=1)
            dh = p["v"].T @ d
            g = {"v": np.einsum("tcb,thb->ch", d, both), "c": d.sum(axis=(0, 2))[:, None]}
            g |= _gru_back(x, p, saved, np.stack((dh[:, :hidden], dh[::-1, hidden:]), axis=1))
            step += 1
            for k in p:
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.01 * (g[k] * g[k] - m2[k])
                p[k] -= rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-6)
    return Model(langs, p)


def fit(docs: DataFrame, train_windows: int = TRAIN_WINDOWS, train_chars: int = TRAIN_CHARS) -> Model:
    """Model from a bounded sample of the labelled documents that are not held out.

    Each language gives the same number of windows, ``train_windows`` in all (one each if there are more
    languages), of ``train_chars`` characters, of which the first ``train_chars`` bytes train; so the sample
    stays below a megabyte at any corpus size and no language is too rare to be learned. Each document offers
    ``DRAWS`` windows and those with the smallest hashes within their language are taken."""
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    labelled = (docs.where(lang.isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
                .select(F.col("doc_id").cast("string").alias("doc"), lang.alias("y"), text.alias("t")))
    rows = {r.y: r.n for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    each = max(1, train_windows // max(len(rows), 1))
    spark = docs.sparkSession
    bounds = F.broadcast(spark.createDataFrame([(y, hash_bound(n * DRAWS, each)) for y, n in rows.items()], "y string, bound long"))
    drawn = labelled.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(DRAWS)))).withColumn("k", F.xxhash64("doc", "draw"))
    start = F.pmod(F.col("k"), F.greatest(F.length("t") - train_chars, F.lit(1))).cast("int") + 1
    windows = (drawn.join(bounds, "y").where(F.col("t").isNotNull() & (F.col("k") <= F.col("bound")))
               .select("k", "y", F.substring(F.col("t"), start, F.lit(train_chars)).alias("w")).where(F.col("w").rlike(r"\p{L}")))
    place = F.row_number().over(Window.partitionBy("y").orderBy("k", "w"))
    sample = windows.withColumn("place", place).where(F.col("place") <= each).orderBy("y", "place").collect()
    return train([r.w.encode()[:train_chars] for r in sample], [r.y for r in sample])


def _window_sums(model: Model, x: np.ndarray, counts: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """(B, C) sums of position probabilities over the last ``counts`` positions of each window (T, B)."""
    out, _ = _gru(x, model.weights, mask)
    steps = len(x)
    total = np.zeros((x.shape[1], len(model.langs)))
    for at in range(steps - int(counts.max(initial=0)), steps, 16):
        prob = _logits(out, model.weights, at, min(at + 16, steps))
        np.minimum(prob, 60, out=prob)
        np.exp(prob, out=prob)
        prob /= prob.sum(axis=1, keepdims=True)
        if (counts < steps - at).any():
            prob *= (counts[None, :] >= steps - np.arange(at, at + len(prob))[:, None])[:, None, :]
        total += prob.sum(axis=0).T
    return total


def document_probabilities(model: Model, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(documents, languages): mean position probability over all bytes of each text."""
    lens = np.diff(offsets)
    sums = np.zeros((len(lens), len(model.langs)))
    # whole windows of longer texts, the last one aligned to the end of the text
    count = np.where(lens >= WINDOW, -(-lens // WINDOW), 0)
    doc = np.repeat(np.arange(len(lens)), count)
    k = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    start = np.minimum(k * WINDOW, lens[doc] - WINDOW)
    fresh = np.minimum(WINDOW, lens[doc] - k * WINDOW)
    order = np.argsort(fresh, kind="stable")[::-1]
    for at in range(0, len(order), BATCH):
        own = order[at:at + BATCH]
        x = data[(offsets[doc[own]] + start[own])[None, :] + np.arange(WINDOW)[:, None]]
        np.add.at(sums, doc[own], _window_sums(model, x, fresh[own], None))
    # shorter texts, padded in front
    short = np.flatnonzero((lens > 0) & (lens < WINDOW))
    short = short[np.argsort(lens[short], kind="stable")]
    for at in range(0, len(short), BATCH):
        own = short[at:at + BATCH]
        width = int(lens[own].max())
        place = np.arange(width)[:, None] - (width - lens[own])[None, :]
        x = np.where(place >= 0, data[np.minimum(offsets[own][None, :] + np.maximum(place, 0), len(data) - 1)], 0)
        np.add.at(sums, own, _window_sums(model, x, lens[own], (place >= 0).astype(np.float32)))
    return sums / np.maximum(lens, 1)[:, None]


def predict_batch(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Predicted language and score in 0..1 of each text."""
    if not model.langs:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    prob = document_probabilities(model, *utf8(texts))
    has = np.array([bool(t and LETTER.search(t)) for t in texts.to_pylist()], bool)
    best = prob.argmax(axis=1)
    score = np.where(has, np.clip(prob[np.arange(len(best)), best], 0, 1), 0.0)
    return [model.langs[b] if h else UNDETERMINED for b, h in zip(best, has)], score


def predict(docs: DataFrame, model: Model, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` with the predicted language and its score; replaces such columns."""
    own = docs.drop(lang_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            langs, score = predict_batch(shared.value, batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                                             [*batch.schema.names, lang_col, score_col])

    schema = own.withColumn(lang_col, F.lit("")).withColumn(score_col, F.lit(0.0)).schema
    return own.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents whose language is identified: not ``und`` and with a score of at least ``min_score``."""
    scored = predict(docs, model, "__lang_pred", "__score")
    return scored.where((F.col("__lang_pred") != UNDETERMINED) & (F.col("__score") >= min_score)).select(*docs.columns)
