"""Operators 6 and 10 and the pipeline."""

import itertools
import random
import zlib
from collections import Counter
from fractions import Fraction
from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from stallboard.llm import decontaminate as D
from stallboard.llm import language_id as L
from stallboard.llm import mixing as M
from stallboard.llm import sharding as R
from stallboard.llm import simhash_dedup as S

SCHEMA = "doc_id long, text string, source string, lang string, shard string, slot string, mix_block string"
DIRECTORY = "/root/testdata/sf0.001"
CLASHING = ["mix_block", "shard", "slot", "old_shard", "__piece", "stream_rank", "stream_position", "row", "rank", "root", "size"]


def deviation(order, weights, sizes):
    """Largest distance in blocks of any source from its target up to the slot where the first source is empty."""
    total = sum(weights.values())
    share = np.array([weights[s] / total for s in weights])
    number = {s: k for k, s in enumerate(weights)}
    done, worst = np.zeros(len(share)), 0.0
    for t, s in enumerate(order, 1):
        done[number[s]] += 1
        worst = max(worst, np.abs(done - t * share).max())
        if done[number[s]] == sizes[s]:
            return worst
    return worst


def test_schedule_keeps_the_target_weights():
    """Less than one block from the target weights themselves, over 200 000 blocks and with 10 000 sources."""
    goal = {"a": 0.3334, "b": 0.3333, "c": 0.2333, "d": 0.1}
    sizes = {"a": 66_680, "b": 80_000, "c": 80_000, "d": 90_000}
    order = [s for s, _ in islice(M.edf(sizes, goal), 200_000)]
    assert deviation(order, goal, sizes) < 1
    goal = {f"s{k:05}": 1e-4 for k in range(20)} | {"big": 1.0}
    sizes = {s: 100_000 if s == "big" else 50 for s in goal}
    assert deviation([s for s, _ in M.edf(sizes, goal)], goal, sizes) < 1
    rng = random.Random(1)
    goal = {f"s{k:05}": rng.random() ** 3 + 1e-3 for k in range(10_000)}
    sizes = {s: rng.randint(5, 30) for s in goal}
    assert deviation([s for s, _ in islice(M.edf(sizes, goal), 20_000)], goal, sizes) < 1
    assert Counter(s for s, _ in M.edf(sizes, goal)) == Counter(sizes)


def test_schedule_follows_the_ideal_stream_to_the_end():
    """Every block of random sources once, in order, and always within one block of the ideal stream with renewed weights."""
    rng = random.Random(4)
    for _ in range(40):
        sizes = {f"s{k}": rng.randint(0, 90) for k in range(rng.randint(1, 12))}
        goal = {s: rng.choice([0.1, 0.25, 1.0, 3.0, rng.random() + 0.01]) for s in sizes}
        order = list(M.edf(sizes, goal))
        assert len(order) == sum(sizes.values())
        done = Counter()
        served, left = Counter(), {s: Fraction(n) for s, n in sizes.items() if n}
        for s, k in order:
            assert done[s] == k
            done[s] += 1
            time = Fraction(1)  # one slot of the ideal stream, source by source as they run out
            while time and left:
                weight = sum(Fraction(goal[x]) for x in left)
                step = min([time] + [left[x] * weight / Fraction(goal[x]) for x in left])
                for x in list(left):
                    part = step * Fraction(goal[x]) / weight
                    served[x] += part
                    left[x] -= part
                    if not left[x]:
                        del left[x]
                time -= step
            assert all(abs(done[x] - served[x]) < 1 for x in sizes)


def mixed_rows():
    rows = [(k, f"text {k}", "hot" if k % 3 else f"src{k % 5}", "en", "x", "y", "z") for k in range(2500)]
    return rows + [(None, None, None, None, None, None, None), (5000, "", "", "en", "", "", ""), rows[0], rows[0], (None, "a", "hot", None, None, None, None)]


def test_mix(spark):
    rows = mixed_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    goal = {"hot": 0.5, "src0": 0.3, "src1": 0.1, "src2": 0.05, "src3": 0.03, "src4": 0.02}
    got = M.mix(df, goal, block_docs=4, default_weight=0.01).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(len(rows)))
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert [r.mix_slot for r in got] == sorted(r.mix_slot for r in got)
    sources = {r.mix_source for r in got}
    slots = {r.mix_slot: r.mix_source for r in got}
    assert all(len({r.mix_block for r in got if r.mix_slot == t}) == 1 for t in list(slots)[:50])
    # until the first source runs out it is within one block of the target weights
    assert deviation([slots[t] for t in range(len(slots))], {s: goal.get(s, 0.01) for s in sources}, Counter(slots.values())) < 1
    assert M.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = df.withColumnsRenamed({"mix_block": "__piece", "slot": "row", "shard": "rank"})
    again = M.mix(clash, prefix="p_")
    assert again.columns == [*clash.columns, "p_source", "p_block", "p_slot", "p_position"]
    assert Counter((r.doc_id, r["__piece"], r["row"], r["rank"]) for r in again.collect()) == Counter((r[0], r[6], r[5], r[4]) for r in rows)
    with pytest.raises(ValueError):
        M.mix(df, {"hot": 0.0})


def least_bytes(sizes, shards):
    """Fewest bytes moved over all layouts with counts at most one apart: ``sizes`` are (old shard, bytes) of each row."""
    low, extra = divmod(len(sizes), shards)
    best = float("inf")
    for larger in itertools.combinations(range(shards), extra):
        cost = sum(x for s, x in sizes if not 0 <= s < shards)
        for j in range(shards):
            own = sorted(x for s, x in sizes if s == j)
            cost += sum(own[:max(0, len(own) - low - (j in larger))])
        best = min(best, cost)
    return best


def test_flow_moves_fewest_bytes():
    rng = random.Random(7)
    for _ in range(150):
        shards = rng.randint(1, 6)
        blocks = [(rng.randint(-1, shards - 1), rng.randint(1, 12), float(rng.randint(1, 90))) for _ in range(rng.randint(1, 25))]
        flow = R.min_cost_flow(blocks, shards)
        assert all(sum(n for b, _, n in flow if b == k) == blocks[k][1] for k in range(len(blocks)))
        count = [sum(n for _, j, n in flow if j == s) for s in range(shards)]
        assert max(count) - min(count) <= 1
        moved = sum(n * blocks[b][2] for b, j, n in flow if blocks[b][0] != j)
        assert moved == least_bytes([(s, c) for s, n, c in blocks for _ in range(n)], shards)


def test_reshard_moves_fewest_bytes(spark):
    """The whole operator against the least over all layouts, with an empty shard and rows without one."""
    rng = random.Random(9)
    cases = [[(0, 1)] * 5 + [(1, 100)] * 5]
    cases += [[(rng.choice([0, 0, 0, 1, 2, 3, None]), rng.choice([3, 50, 51, 52, rng.randint(1, 4000)])) for _ in range(rng.randint(1, 60))] for _ in range(4)]
    for rows in cases:
        docs = spark.createDataFrame([(k, "x" * n, s) for k, (s, n) in enumerate(rows)], "doc_id long, text string, place int")
        out = R.reshard(docs, F.col("place"), 3 if len(rows) == 10 else 4).collect()
        moved = sum(len(r.text) + 8 for r in out if r.old_shard != r["shard"])
        assert moved == least_bytes([(-1 if s is None else s, n + 8) for s, n in rows], 3 if len(rows) == 10 else 4)


def test_reshard(spark, tmp_path):
    rows = mixed_rows() + [(6000, "é" * 40_000, "hot", "en", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("old_place", F.when(F.col("source") == "hot", 2).otherwise(F.col("doc_id") % 7))
    got = R.reshard(df, F.col("old_place"), shards=5)
    assert got.columns == ["doc_id", "text", "source", "lang", "mix_block", "old_place", "old_shard", "shard", "slot"]
    out = got.collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    count = Counter(r.shard for r in out)
    assert set(count) == set(range(5)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(count[s]))
    # within an old shard nothing that moved is larger than what stayed
    for s in range(5):
        stayed = [len((r.text or "").encode()) for r in out if r.old_shard == s and r.shard == s]
        gone = [len((r.text or "").encode()) for r in out if r.old_shard == s and r.shard != s]
        if stayed and gone:
            assert max(gone) <= min(stayed)
    path = str(tmp_path / "shards")
    old = R.write_layout(df, F.col("old_place"), path)
    before = {p.name: sorted(x.name for x in p.iterdir()) for p in (tmp_path / "shards").iterdir() if p.is_dir()}
    affected = R.rewrite(old, path, 5)
    kept = [f"shard={s}" for s in range(5) if s not in affected and f"shard={s}" in before]
    assert all(sorted(x.name for x in (tmp_path / "shards" / name).iterdir()) == before[name] for name in kept)
    assert Counter(r["shard"] for r in spark.read.parquet(path).collect()) == count
    assert R.rewrite(R.read_layout(spark, path, old.schema), path, 5) == []
    assert R.reshard(spark.createDataFrame([], SCHEMA), F.lit(0)).collect() == []


def test_fewer_shards_leave_no_old_files(spark, tmp_path):
    """From 9 shards and rows without one to 4, read back without filters; rows that leave are the smallest."""
    rows = [(k, "x" * (1000 + 37 * k % 150), "s", "en", k % 9 if k % 10 else None) for k in range(900)] + [
        (2000 + k, "x" * (1000 + 31 * k % 150), "s", "en", 2) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, place int")
    path = str(tmp_path / "shards")
    old = R.write_layout(docs, F.col("place"), path)
    placed = R.reshard(old, F.col("shard"), shards=4)
    out = placed.collect()
    gone, stayed = ([len(r.text) for r in out if r.old_shard == 2 and (r.shard == 2) == stay] for stay in (False, True))
    assert gone and stayed and max(gone) <= min(stayed)
    assert set(R.rewrite(old, path, 4)) >= {4, 5, 6, 7, 8}
    back = spark.read.parquet(path)
    assert Counter(r.doc_id for r in back.collect()) == Counter(r[0] for r in rows)
    assert {r.doc_id: r["shard"] for r in back.collect()} == {r.doc_id: r["shard"] for r in out}
    assert not list((tmp_path / "shards").glob("_rewrite-*"))
    # broken off before the mark: undone; after it: ended
    (tmp_path / "shards" / "_rewrite-1" / "shard=0").mkdir(parents=True)
    R.recover(spark, path)
    assert spark.read.parquet(path).count() == len(rows)
    (tmp_path / "shards" / "_rewrite-2" / "_gone" / "shard=0").mkdir(parents=True)
    (tmp_path / "shards" / "_rewrite-2" / "_COMMITTED").touch()
    R.recover(spark, path)
    assert spark.read.parquet(path).where("shard = 0").count() == 0


def test_queries_over_the_small_tables(spark):
    q = E.queries()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()}
    got = q["op10_sharding"](spark, DIRECTORY).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(24)) and max(count.values()) - min(count.values()) <= 1
    assert sorted(r.position for r in q["op6_mixing"](spark, DIRECTORY).collect()) == list(range(len(docs)))
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in q if k.startswith("op")} and "pipeline" in q


def test_shards_follow_the_mixed_stream(spark, tmp_path):
    """Slots follow the written stream, and every shard's prefix the target weights until a source runs out."""
    sizes = {"hot": 4000, "b": 1500, "c": 1500, "d": 700}
    rows = [(k, f"{s} {k}" + " x" * (k % 9), s) for s, n in sizes.items() for k in range(10_000 * len(s) + ord(s[0]) * 100_000, 10_000 * len(s) + ord(s[0]) * 100_000 + n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    path = str(tmp_path / "mixed")
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(path)
    mixed = spark.read.parquet(path)
    position, _ = (c for c in mixed.columns if corpus_pipeline.STREAM.fullmatch(c))
    stream = {r.doc_id: r[position] for r in mixed.collect()}
    assert sorted(stream.values()) == list(range(len(rows)))
    out = corpus_pipeline.shard(spark, spark.read.parquet(path), "").collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    share = M.damped_weights(sizes)
    period = sum(share.values())
    for j in range(R.SHARDS):
        own = sorted((r.slot, stream[r.doc_id], r.source) for r in out if r.shard == j)
        assert [x[0] for x in own] == list(range(len(own)))
        assert [x[1] for x in own] == sorted(x[1] for x in own)
        done = Counter()
        for n, (_, _, s) in enumerate(own, 1):
            done[s] += 1
            if done[s] >= sizes[s] // R.SHARDS - 1:
                break
            assert all(abs(done[x] - n * share[x] / period) < 6 for x in share)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_equals_its_operators(spark, tmp_path, empty):
    """run() against the operators applied to plain Python rows; clean documents stay."""
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    if empty:
        docs = docs.limit(0)
    else:
        schema = docs.schema
        odd = [(9001, None, "en", "src1", 0), (9002, "", None, None, None), (9003, "12 + 13", "en", "src2", 7)]
        docs = docs.unionByName(spark.createDataFrame(odd, schema)).withColumn("fp", F.lit("clash"))
    for k, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.concat_ws("/", F.lit(str(k)), F.col("doc_id").cast("string")))
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{DIRECTORY}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    out = corpus_pipeline.run(spark, sf)
    got = out.collect()
    assert out.columns == [*docs.columns, "old_shard_", "shard_", "slot_"]
    if empty:
        assert got == []
        return
    assert all(r[name] == f"{k}/{r.doc_id}" for r in got for k, name in enumerate(CLASHING))
    rows = docs.collect()
    import pyarrow as pa
    model = L.fit(docs)
    langs, score = L.predict_batch(model, pa.array([r.text for r in rows], pa.string()))
    kept = [r for r, lang, s in zip(rows, langs, score) if lang != "und" and s >= L.MIN_SCORE]
    assert {9001, 9002, 9003}.isdisjoint(r.doc_id for r in kept) and len(kept) >= len(rows) - 6
    fps = {r.doc_id: S.fingerprint(r.text) for r in kept}
    from tests.llm.test_dedup_decontaminate import plain_components
    root = plain_components(fps)
    kept = [r for r in kept if root[r.doc_id] == r.doc_id]
    bench = [(r.item_id, " ".join(D.words(r.text)), D.needed_score(len(D.words(r.text)), D.MIN_SCORE)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [r for r in kept if not D.text_leaks(r.text, bench)]
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in kept)
    assert {r.doc_id: (r.text, r.lang, r.source) for r in got} == {r.doc_id: (r.text, r.lang, r.source) for r in kept}
    count = Counter(r.shard_ for r in got)
    assert max(count.values()) - min(count.values()) <= 1
