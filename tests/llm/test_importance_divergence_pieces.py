"""Operators 11 to 13 against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from stallboard.llm import divergence, importance, sentence_pieces

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def random_texts(n, seed, most=60):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "gamma7", "é", "ÉCOLE", "naïve", "1234", "x", "日本", "don't", "a-b", "the", "the", "the", "of", "\x00"]
    return ["".join(rnd.choice(words) + rnd.choice([" ", "  ", "\n", ", ", "_"]) for _ in range(rnd.randrange(most))) for _ in range(n)]


def grams(text, n):
    w = WORDS.findall(lower(text))
    return [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute_scores(docs, target, buckets, max_n):
    corpus, wanted = collections.Counter(), collections.Counter()
    for counter, texts in ((corpus, [t for _, t in docs]), (wanted, target)):
        for t in texts:
            counter.update(zlib.crc32(g.encode()) % buckets for g in grams(t, max_n))
    many, goal = sum(corpus.values()), sum(wanted.values())
    out = []
    for doc_id, text in docs:
        own = [zlib.crc32(g.encode()) % buckets for g in grams(text, max_n)]
        gain = [math.floor(1000 * math.log((wanted[b] + 1.0) * (many + buckets) / ((corpus[b] + 1.0) * (goal + buckets)))) for b in own]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(WORDS.findall(lower(text))), len(own), weight,
                    weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize("max_n", [1, 3])
def test_resampling_equals_brute_force(spark, max_n):
    docs = list(enumerate(random_texts(300, 1))) + [(None, "the of the " * 10), (500, None), (501, ""), (7, "again " * 30), (7, "again " * 30), (502, "long " * 200_000)]
    target = ["The naïve école 1234", None, "", "gamma7 gamma7"]
    expected = brute_scores(docs, target, 97, max_n)
    eligible = sorted((r for r in expected if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    best = [(*r, k + 1) for k, r in enumerate(eligible[:len(eligible) * 10 // 100])]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, rank string, score int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in importance.drawn(frame, goal, buckets=97, max_n=max_n).collect()]
    assert sorted((r for r in got if r[5] is not None), key=lambda r: r[5]) == best
    assert collections.Counter(r[:5] for r in got) == collections.Counter(expected)
    kept = importance.resample(frame, goal, buckets=97, max_n=max_n).collect()
    first = {}
    for r in best:
        first.setdefault(r[0], r[5])
    assert collections.Counter((r.doc_id, r.text, r["rank"]) for r in kept) == collections.Counter((d, t, first[d]) for d, t in docs if d in first)


def test_ranks_of_ties_and_repeated_rows(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1, 2, 3]), 30, 30, 0, rnd.choice([5, 5, 5, 6])) for _ in range(4000)]
    got = importance.rank_rows(spark.createDataFrame(rows, importance.SCORES).repartition(7), 16).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 4001))
    in_order = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in sorted(got, key=lambda r: r["rank"])]
    assert in_order == sorted(in_order)


def test_equal_keys_are_dealt_over_segments():
    cuts = np.array([[1, 0, 0, 0, 0], [5, 0, 0, 0, 0], [5, 0, 0, 0, 0], [5, 0, 0, 0, 0], [9, 0, 0, 0, 0]])
    keys = np.array([[k, 0, 0, 0, 0] for k in [0, 1, 3, 9, 10] + [5] * 40])
    own = importance.segment_of(keys, cuts)
    assert own[0] == 0 and own[1] in (0, 1) and own[2] == 1 and own[3] in (4, 5) and own[4] == 5
    assert set(own[5:].tolist()) == {1, 2, 3, 4}


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert importance.drawn(docs, docs.select("text")).collect() == []
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [(r.doc_id, r.n_features, r["rank"]) for r in importance.drawn(some, docs.select("text")).collect()] == [(1, 3, None)]


def brute_audit(rows, min_docs, ranks):
    docs = [(lang or "", source or "", collections.Counter(LETTERS.findall(lower(text)))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for _, _, c in own for t in c)
        kept = sorted(t for t in df if df[t] >= min_docs)
        v = len(kept)
        by = collections.defaultdict(collections.Counter)
        for _, source, c in own:
            by[source].update(c)

        def shares(counter):
            n = sum(counter[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counter[t] + 2) // (n + 2 * v) for t in kept}

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        whole = shares(sum(by.values(), collections.Counter()))
        p = {s: shares(c) for s, c in by.items()}
        for s in by:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in by if o != s)
            out |= {(lang, s, "pair", o.decode(), -x, k + 1) for k, (x, o) in enumerate(pair)}
            term = sorted((-f(p[s][t], whole[t]), t.encode()) for t in kept if by[s][t] and p[s][t] > whole[t])[:ranks]
            out |= {(lang, s, "term", t.decode(), -x, k + 1) for k, (x, t) in enumerate(term)}
    return out


def test_audit_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["en", "en", "en", "de", None, ""]), rnd.choice(["a", "b", "c", "é", None]), t) for t in random_texts(400, 2, 25)]
    rows += [("en", "a", " ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)))] * 12  # many terms in one cell
    rows += [("fr", "only", "un deux"), ("it", "x", None), ("it", "y", ""), ("en", "silent", None), ("en", "b", "word " * 100_000)]
    frame = spark.createDataFrame([(*r, 1, "n") for r in rows], "lang string, source string, text string, n int, term string")
    got = [tuple(r) for r in divergence.audit(frame, 10, 10).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, 10, 10)
    assert any(r[0] == "it" and r[2] == "pair" and r[4] == 0 for r in got)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_audit_with_few_documents_a_term(spark):
    rnd = random.Random(6)
    rows = [("l", rnd.choice("abcdef"), t) for t in random_texts(150, 4, 20)]
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    whole = set(map(tuple, divergence.audit(frame, 3, 5).collect()))
    assert whole == brute_audit(rows, 3, 5)


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rnd = random.Random(8)
    alphabet = list("aabbeehtsin  \n\t▁é漢字Ωж0123 <s>\x00ა😀.,") + ["the", "ing", "    ", "<0x0A>", "er"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(50))) for _ in range(3000)]
    return texts + ["", None, " ", "a" * 3000, " " * 5000, "é" * 100, "日本語テキスト" * 50, "<s></s><unk>", "word " * 100_000]


def test_ids_equal_the_library(model):
    table = sentence_pieces.PieceTable(model)
    texts = odd_texts()
    ids, offsets = table.encode(texts)
    expected = table.library.encode([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == expected
    # the same when the remembered segments are dropped, and without cutting into segments
    table.forget()
    whole = [table.encode_segment(sentence_pieces.SPACE + t.replace(" ", sentence_pieces.SPACE)) if t else [] for t in texts[:800]]
    assert whole == expected[:800]


def test_each_prefix_has_one_last_token(model):
    table = sentence_pieces.PieceTable(model)
    for text in ("▁hello▁▁▁world", "▁there▁in▁the▁▁▁▁▁other", "▁aaaaabbbb"):
        for end in range(2, len(text) + 1):
            prefix = text[:end]
            last = table.library.encode(prefix[1:].replace("▁", " "))[-1]
            ending = [k for k in table.sides if prefix.endswith(table.names[k])]
            fits = [k for k in ending if len(table.names[k]) == end
                    or table.compatible(table.encode_segment(prefix[:-len(table.names[k])])[-1], k)]
            assert fits == [last]


def test_spark_encoding_and_decoding(spark, model):
    texts = odd_texts()
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in sentence_pieces.decode(sentence_pieces.encode(frame, model), model).collect()}
    library = sentence_pieces.library(model)
    for k, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[k].ids == ids and got[k].decoded == library.decode(ids) and got[k].text == t
    again = sentence_pieces.encode(frame, model, decoded=True).collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in again} == {k: (r.ids, r.decoded) for k, r in got.items()}
    empty = frame.where("false")
    assert sentence_pieces.decode(sentence_pieces.encode(empty, model), model).collect() == []


def test_queries_over_the_small_tables(spark, sf_dir):
    import public_tokenizers
    import sentencepiece

    from stallboard.llm import queries
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECES))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_sentence_pieces"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
