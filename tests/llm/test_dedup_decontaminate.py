"""Operators 8 and 2 against brute force."""

import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from stallboard.llm import decontaminate as D
from stallboard.llm import simhash_dedup as S
from stallboard.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, fp string, label int, anchor long"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=2):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_golay_code_is_perfect():
    syn = S._syndromes()
    starts, patterns = S._patterns(0)[0]
    assert (np.diff(starts) == 1).all() and (syn[patterns] == np.arange(2048)).all()


def test_anchors_meet():
    """Any two words up to 2 bits apart meet at the home anchor of either; none is missed."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(2):
        y ^= np.where(rng.random(3000) < 0.8, np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64), np.uint64(0))
    row, home = S.anchors(x.view(np.int64), 2, True)
    assert (row == np.arange(3000)).all()
    row, every = S.anchors(y.view(np.int64), 2, False)
    assert len(set(zip(row.tolist(), every.tolist()))) == len(row)
    found = np.zeros(3000, bool)
    found[row[every == home[row]]] = True
    assert found.all()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    rows = []
    for k in range(60):
        body = [rng.choice(words) for _ in range(rng.choice([2, 3, 30, 400]))]
        rows.append((k, " ".join(body), "en", "x", 1, 2))
        for j in range(rng.randint(0, 3)):
            copy = list(body)
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 + 10 * k + j, rng.choice([" ", "\n", "\t "]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy), "en", None, None, None))
    rows += [(2000, None, None, None, None, None), (2001, "", "en", "", 1, 1), (2002, " \n\x0b", "en", "", 1, 1), (None, "only without id", "en", "", 1, 1),
             (2003, "one", "en", "", 1, 1), (2004, "ONE", "en", "", 1, 1), rows[0], (None, rows[0][1], "en", "", 0, 0), (2005, "É é", "en", "", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.near_duplicates(df).collect()
    numbers = [plain_fingerprint(r[1]) for r in rows]
    root = plain_components(dict(enumerate(numbers)))
    least = {}
    for k, r in enumerate(rows):
        least.setdefault(root[k], []).append(r[0])
    want = [min((i for i in least[root[k]] if i is not None), default=None) for k in range(len(rows))]
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter(
        (r[0], f"{f:016x}", w) for r, f, w in zip(rows, numbers, want))
    kept = S.deduplicate(df)
    assert kept.columns == df.columns
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    classes = {}
    for k, r in enumerate(rows):
        classes.setdefault(root[k], []).append(r)
    assert sum(found.values()) == len(classes)
    for own in classes.values():  # the smallest id of each class, once
        first = min((r[0] for r in own if r[0] is not None), default=None)
        assert sum(found[(r[0], r[1])] for r in {r[:2]: r for r in own if r[0] == first}.values()) == 1
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_links_are_all_links(spark):
    """Links between random fingerprints, planted neighbours and a dense group, against all pairs."""
    rng = random.Random(12)
    fps = {rng.getrandbits(64) for _ in range(200)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps)[:80]}
    fps |= {1 << b for b in range(40)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b) for r in S.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(min(signed[a], signed[b]), max(signed[a], signed[b]))
                   for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 2}


def test_one_id_on_two_texts(spark):
    """A clean text stays although its id also stands on a copy of another document; rows without id link like others."""
    ships = "the old ships left the harbour before the storm came in from the west " * 4
    birds = "small birds build their nests high in the trees of the quiet garden every spring " * 4
    rows = [(0, birds), (1, ships), (1, birds), (None, ships), (None, "alone without an id"), (None, "alone without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in S.deduplicate(df).collect()) == [
        (False, 0, birds), (False, 1, ships), (True, 0, "alone without an id")]


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: find(i) for a, b in edges for i in (a, b) if find(i) != i}


def plain_alignment(item, window):
    h = np.zeros((len(item) + 1, len(window) + 1), int)
    for i in range(len(item)):
        for j in range(len(window)):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if item[i] == window[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_smith_waterman_equals_the_plain_table():
    rng = np.random.default_rng(7)
    for _ in range(200):
        item, window = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        score, first, last = D.smith_waterman(item, window)
        assert score == plain_alignment(item, window)
        if score:
            assert plain_alignment(item, window[first:last + 1]) == score


def leaking_rows():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(3000)]

    def text(n):
        return [rng.choice(words) for _ in range(n)]
    items = [text(rng.randint(20, 60)) for _ in range(30)]
    rows, planted = [], set()
    for k in range(150):
        body = text(rng.randint(0, 400))
        if k < 75:
            i = k % 30
            copy = list(items[i])
            for _ in range(len(copy) // 8 if k % 3 else 0):  # edits: replace, drop, insert
                at = rng.randrange(len(copy))
                copy[at:at + 1] = rng.choice([[rng.choice(words)], [], [copy[at], rng.choice(words)]])
            at = rng.randint(0, len(body))
            body = body[:at] + copy + body[at:]
            planted.add((k, i))
        rows.append((k, " ".join(body), "en", "a", 1, 2))
    rows += [(500 + k, " ".join(items[4]) + " .", "en", "b", 1, 2) for k in range(60)]
    planted |= {(500 + k, 4) for k in range(60)}
    bench = [(i, " ".join(t).upper() + "!") for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "too few words!"), (93, "seven"), (94, "words, two")]
    return rows, bench, planted


def test_copies_and_edited_copies_are_found(spark):
    rows, bench, planted = leaking_rows()
    rows += [(900, None, None, None, None, None), (901, "", "en", "a", 1, 2), (902, "here are TOO few words again", "en", "a", 1, 2), (None, "x y z", "en", "a", 1, 2),
             (903, "too few other words", "en", "a", 1, 2), (904, "Seven.", "en", "a", 1, 2), (905, "seven words, two more", "en", "a", 1, 2), (906, "words two", "en", "a", 1, 2)]
    planted |= {(902, 92), (904, 93), (906, 94)}  # short items: whole ones only
    df, items = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")
    got = D.leaks(df, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted and all(r.score >= D.MIN_SCORE for r in got)
    assert {r.item_id: r.score for r in got if r.item_id > 90} == {92: 1.0, 93: 1.0, 94: 1.0}
    assert len(D.leaks(df, items.unionByName(items)).collect()) == len(got)
    clean = D.remove_leaking(df, items)
    assert clean.columns == df.columns
    left = Counter(r.doc_id for r in clean.collect())
    assert left == Counter(r[0] for r in rows if r[0] not in {d for d, _ in planted})


def test_edits_up_to_the_limit_equal_all_alignments(spark):
    """Every pair that Smith-Waterman of all pairs scores, with edits up to the limit and half copies in many documents."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    items = [[rng.choice(words) for _ in range(rng.randint(8, 40))] for _ in range(12)]
    bodies = []
    for k in range(150):
        copy = list(items[k % 12])
        if k % 3 == 0:  # every 4th word replaced: the score is the limit
            copy[3::4] = ["new"] * len(copy[3::4])
        elif k % 3 == 1:
            for _ in range(rng.randint(0, len(copy) // 2)):
                at = rng.randrange(len(copy))
                copy[at:at + 1] = rng.choice([["new"], [], [copy[at], "new"]])
        else:
            copy = copy[:rng.randint(len(copy) // 2, len(copy) // 2 + 2)]
        around = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        bodies.append(around + copy + around[:7])
    bodies += [[w for k in range(0, len(item), 2) for w in (*item[k:k + 2], "new")] for item in items]  # no 3-gram left
    df = spark.createDataFrame([(k, " ".join(b), "en", "a", 1, 2) for k, b in enumerate(bodies)], SCHEMA)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    want = {}
    for d, body in enumerate(bodies):
        for i, item in enumerate(items):
            score = D.smith_waterman(np.array([hash(w) for w in item]), np.array([hash(w) for w in body]))[0] / len(item)
            if score >= D.MIN_SCORE:
                want[d, i] = score
    assert sum(score < 0.7 for score in want.values()) > 40
    assert {(r.doc_id, r.item_id): r.score for r in D.leaks(df, bench).collect()} == want


def test_seeds_are_the_rarest_pairs(spark):
    """As many seeds as no leak can do without, by the frequency of the pairs over all documents."""
    item = [f"w{k}" for k in range(12)]
    docs = [(k, " ".join(item[k % 6:k % 6 + 4])) for k in range(60)] + [(99, "w10 w11")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = D.item_table(spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    held = D.document_pairs(df, D.bit_table(items.select(F.explode("pairs").alias("pair"))))
    frequency = Counter(p for _, t in docs for p in set(zip(t.split(), t.split()[1:])))
    code = dict(zip(zip(item, item[1:]), items.first().pairs))
    found = {r.pair for r in D.seeds(items, held).collect()}
    rarest = sorted(code, key=lambda p: (frequency[p], item.index(p[0])))[:12 - 6 + 1]
    assert found == {code[p] for p in rarest if frequency[p]}
    assert {r.pair: r.n for r in held.groupBy("pair").agg(F.sum("n").alias("n")).collect() if r.pair in code.values()} == {code[p]: n for p, n in frequency.items()}


def test_given_benchmark_passages(spark):
    """Every document that holds a whole item's words leaks, and no other but near copies of one."""
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id for r in D.leaks(docs, items).collect()}
    joined = [" ".join(D.words(r.text)) for r in items.collect()]
    whole = {r.doc_id for r in docs.collect() if any(f" {j} " in f" {' '.join(D.words(r.text))} " for j in joined)}
    assert whole and whole <= got and len(got - whole) <= 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "a", 1, 2)], SCHEMA)
    none, no_docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert D.leaks(docs, none).collect() == [] and D.remove_leaking(docs, none).count() == 1
    assert D.leaks(no_docs, items).collect() == [] and D.remove_leaking(no_docs, items).count() == 0
