"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallboard.llm import (bit_pack, chat_format, decontaminate, divergence, html_extract, importance, language_id, mixing, quality_rules,
                            sentence_pieces, sharding, simhash_dedup, suffix_dedup)
from stallboard.llm.common import group_ranks, parallelism, read, scratch_path

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
PLANTED = r"\### Assistant: </turn> ok"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = read(spark, sf_dir, "pages")
    return html_extract.main_texts(pages, html_extract.fit(pages))


@register
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of every leak of a test item into a document."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = read(spark, sf_dir, "documents")
    scored = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return scored.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@register
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, word figures, base_failed, kept and the two distances of every document."""
    docs = read(spark, sf_dir, "documents")
    judged = quality_rules.judge(docs, quality_rules.fit(docs))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


@register
def op5_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the packed files."""
    import public_tokenizers

    path = scratch_path(spark, "op5")
    bit_pack.write(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), path)
    return bit_pack.documents(bit_pack.blocks(spark, path))


@register
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, slot and position in the mixed stream of every document."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_block").alias("block"),
                        F.col("mix_slot").alias("slot"), F.col("mix_position").alias("position"))


@register
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, and the text that is left."""
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


@register
def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    return simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


@register
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns and digests of every conversation and of conversation -7, read back from the formatted pieces."""
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)],
                                    "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(planted)))


def source_shard(shards: int):
    """The given layout: every source lies in the shard of its name's checksum."""
    return (F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")) % shards).cast("int")


@register
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, read back from the rewritten shards."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "source", "text", sharding.text_size().alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"))
    path = scratch_path(spark, "op10")
    old = sharding.write_layout(docs, source_shard(sharding.SHARDS), path)
    sharding.rewrite(old, path)
    new = sharding.read_layout(spark, path, old.schema).withColumn("old_shard", source_shard(sharding.SHARDS))
    placed = group_ranks(new, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")],
                         F.concat_ws("/", "doc_id", "text_crc32"), "slot", max(parallelism(spark) // 4, 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "old_shard")


@register
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score of every document and the rank of the drawn ones."""
    ranked = importance.drawn(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


@register
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank: divergence of every (lang, source) group from other sources and of its terms."""
    return divergence.audit(read(spark, sf_dir, "documents"))


@register
def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    import public_tokenizers

    model = public_tokenizers.path(PIECES)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentence_pieces.encode(docs, model, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus_pipeline.run over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _distance_sql(p: str, q: str) -> str:
    """Jensen-Shannon distance of two joined share columns, as an aggregate."""
    def part(x: str) -> str:
        return f"CASE WHEN {x} > 0 THEN {x} * LOG2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"SQRT(GREATEST(SUM({part(p)} + {part(q)}) / 2, 0))"


_CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{Lt}\p{Lm}\p{Lo}\p{M}", r"\p{N}", r"\p{Z}\x09-\x0D", r".,;:!?'\"()\-")
_COUNTS = [f"length(regexp_replace(text, '[^{c.replace(chr(39), chr(39) * 2)}]', '', 'g'))" for c in _CLASSES]

ORACLE["op4_quality_rules"] = f"""
WITH known AS (SELECT lang FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang HAVING COUNT(*) >= {quality_rules.MIN_REFERENCE_DOCS}
               AND SUM(len(regexp_extract_all(lower(text), '\\p{{L}}+|[^\\p{{L}}\\p{{N}}_\\s]+'))) >= {quality_rules.MIN_REFERENCE_WORDS}),
d AS (SELECT ROW_NUMBER() OVER () AS k, doc_id, CASE WHEN lang IN (SELECT lang FROM known) THEN lang END AS lang, COALESCE(text, '') AS text FROM documents),
w AS (SELECT k, lang, text, doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
u AS (SELECT k, len(ws) AS n, unnest(range(1, len(ws) - {quality_rules.WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {quality_rules.WINDOW}),
g AS (SELECT k, i, COUNT(*) OVER (PARTITION BY k, list_slice(ws, i, i + {quality_rules.WINDOW - 1})) AS c FROM u),
rp AS (SELECT k, COUNT(DISTINCT i + j) AS n_repeat FROM g, range(0, {quality_rules.WINDOW}) t(j) WHERE c > 1 GROUP BY k),
ln AS (SELECT k, COUNT(*) - COUNT(DISTINCT line) AS n_dup FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)
       WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k),
b AS (SELECT w.k, w.doc_id, w.lang, w.text, CAST(len(ws) AS BIGINT) AS n_words, CAST(COALESCE(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             COALESCE(ln.n_dup, 0) AS n_dup_lines, COALESCE(rp.n_repeat, 0) AS n_repeat_words
      FROM w LEFT JOIN rp ON rp.k = w.k LEFT JOIN ln ON ln.k = w.k),
hc AS (SELECT k, lang, {', '.join(f'{c} AS c{i}' for i, c in enumerate(_COUNTS))}, length(text) AS t FROM d),
ch AS (SELECT k, lang, t, unnest([{', '.join(f'c{i}' for i in range(6))}, t - {' - '.join(f'c{i}' for i in range(6))}]) AS c, generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) AS cell FROM hc),
rc AS (SELECT lang, cell, SUM(c) / SUM(SUM(c)) OVER (PARTITION BY lang) AS q FROM ch WHERE lang IS NOT NULL GROUP BY lang, cell),
cd AS (SELECT ch.k, rc.lang, CASE WHEN MAX(t) >= {quality_rules.MIN_CHARS} THEN {_distance_sql('(c / t)', 'q')} ELSE 0 END AS dist
       FROM ch JOIN rc ON rc.cell = ch.cell AND (rc.lang = ch.lang OR ch.lang IS NULL) GROUP BY ch.k, rc.lang),
lw AS (SELECT k, lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+|[^\\p{{L}}\\p{{N}}_\\s]+')) AS word FROM d),
dw AS (SELECT k, lang, word, COUNT(*) AS c FROM lw GROUP BY k, lang, word),
dt AS (SELECT k, SUM(c) AS t FROM dw GROUP BY k),
lt AS (SELECT lang, SUM(c) AS t FROM dw WHERE lang IS NOT NULL GROUP BY lang),
cw AS (SELECT dw.lang, word, SUM(c) / MAX(lt.t) AS q FROM dw JOIN lt ON lt.lang = dw.lang GROUP BY dw.lang, word HAVING SUM(c) >= {quality_rules.COMMON_SHARE} * MAX(lt.t)),
rw AS (SELECT lang, word, q FROM cw UNION ALL SELECT lt.lang, NULL, 1 - COALESCE((SELECT SUM(q) FROM cw WHERE cw.lang = lt.lang), 0) FROM lt),
long_enough AS (SELECT d.k, d.lang, dt.t FROM d JOIN dt ON dt.k = d.k WHERE dt.t >= {quality_rules.MIN_HISTOGRAM_WORDS}),
pw AS (SELECT l.k, rw.lang, rw.word, rw.q, CASE WHEN rw.word IS NULL THEN NULL ELSE COALESCE(dw.c, 0) / l.t END AS p
       FROM long_enough l JOIN rw ON rw.lang = l.lang OR l.lang IS NULL LEFT JOIN dw ON dw.k = l.k AND dw.word = rw.word),
pf AS (SELECT k, lang, q, COALESCE(p, 1 - COALESCE(SUM(p) OVER (PARTITION BY k, lang), 0)) AS p FROM pw),
wd AS (SELECT k, lang, {_distance_sql('p', 'q')} AS dist FROM (SELECT k, lang, q, GREATEST(p, 0) AS p FROM pf) GROUP BY k, lang),
far AS (SELECT b.k, COALESCE((SELECT MIN(dist) FROM cd WHERE cd.k = b.k), 0) AS c, COALESCE((SELECT MIN(dist) FROM wd WHERE wd.k = b.k), 0) AS w FROM b),
v AS (SELECT b.*, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT} * n_words AS base_failed, far.c, far.w
      FROM b JOIN far ON far.k = b.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND c <= {quality_rules.MAX_CHAR_DISTANCE} AND w <= {quality_rules.MAX_WORD_DISTANCE} AS kept,
       ROUND(c, 6) AS char_distance, ROUND(w, 6) AS word_distance
FROM v
"""


def _escaped_sql(column: str, also: str = "") -> str:
    """Characters of an escaped role or text."""
    extra = "".join(f" + (length({column}) - length(replace({column}, '{c}', '')))" for c in also)
    return (f"(length({column}) + (length({column}) - length(replace({column}, '\\', '')))"
            f" + CAST((length({column}) - length(replace({column}, '<|', ''))) / 2 AS BIGINT){extra})")


_PLANTED_SQL = PLANTED.replace("'", "''")
ORACLE["op9_chat_format"] = f"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_PLANTED_SQL}' UNION ALL SELECT -7, 1, 'assistant', '{_PLANTED_SQL}')
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(SUM({len(chat_format.OPEN + chat_format.ROLE_END + chat_format.TURN_END)} + {_escaped_sql('role', '>')} + {_escaped_sql('text')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC_STEP = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

# CRC-32 by its table of 256 entries, folded over the bytes of each distinct word
ORACLE["op11_importance_resampling"] = f"""
WITH RECURSIVE steps AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
                         UNION ALL SELECT i, {_CRC_STEP}, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (SELECT ROW_NUMBER() OVER () AS k, doc_id, {_LOWER} AS text FROM documents),
dw AS (SELECT k, unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS w FROM benchmark),
words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
coded AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(h) / 2 AS BIGINT)),
                 lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                 lambda c, b: xor(c >> 8, crc.t[xor(c, b) % 256 + 1])), 4294967295) % {importance.BUCKETS} AS b FROM words, crc),
dc AS (SELECT b, COUNT(*) AS s FROM dw JOIN coded USING (w) GROUP BY b),
bc AS (SELECT b, COUNT(*) AS t FROM bw JOIN coded USING (w) GROUP BY b),
total AS (SELECT COALESCE((SELECT SUM(s) FROM dc), 0) AS s, COALESCE((SELECT SUM(t) FROM bc), 0) AS t),
gain AS (SELECT dc.b, CAST(floor(1000 * ln(((COALESCE(bc.t, 0) + 1)::DOUBLE * (total.s + {importance.BUCKETS})::DOUBLE)
                / ((dc.s + 1)::DOUBLE * (total.t + {importance.BUCKETS})::DOUBLE))) AS BIGINT) AS g FROM dc LEFT JOIN bc USING (b), total),
weighed AS (SELECT k, COUNT(*) AS n, CAST(floor(SUM(g) / COUNT(*)) AS BIGINT) AS w FROM dw JOIN coded USING (w) JOIN gain USING (b) GROUP BY k),
noise AS (SELECT k, doc_id, CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                 / 4294967296::DOUBLE))) AS BIGINT) AS z FROM d),
scored AS (SELECT doc_id, COALESCE(n, 0) AS n_features, COALESCE(w, 0) AS weight, COALESCE(w, 0) + z AS score FROM noise LEFT JOIN weighed USING (k)),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_features >= {importance.MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS r,
                  COUNT(*) OVER (PARTITION BY n_features >= {importance.MIN_WORDS}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {importance.MIN_WORDS} AND r <= n * {importance.DRAWN_PERCENT} // 100 THEN r END AS rank FROM placed
"""


def _share_sql(count: str, total: str) -> str:
    return f"(1 + (1000000000::HUGEINT * ({count} + 2)) // ({total} + 2 * v))"


ORACLE["op12_source_divergence"] = f"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS k, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, {_LOWER} AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '{_LETTERS}')) AS term FROM d),
kept AS (SELECT lang, term, COUNT(*) AS ln FROM w GROUP BY lang, term HAVING COUNT(DISTINCT k) >= {divergence.MIN_DOCS}),
l AS (SELECT lang, COUNT(*) AS v, SUM(ln) AS lt FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
used AS (SELECT lang, source, term, COUNT(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
gt AS (SELECT g.lang, g.source, COALESCE(SUM(c), 0) AS gt FROM g LEFT JOIN used USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT gt.lang, gt.source, kept.term, COALESCE(c, 0) AS c, {_share_sql('COALESCE(c, 0)', 'gt')} AS p, {_share_sql('ln', 'lt')} AS q
      FROM gt JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN used USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, COALESCE(SUM(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, ROW_NUMBER() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS r FROM pairs
           UNION ALL SELECT lang, source, 'term', item, value, ROW_NUMBER() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= {divergence.RANKS}
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
