"""Thin registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.llm import class_lm, decontamination, hard_negatives, language_id, mixing, near_dedup, packing, prefix_trie, quality_classifier, quality_rules, suffix_dedup, url_filters, warc
from paneloom.llm.common import fold, table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = quality_rules.judged(docs)
    fences = [c for c in found.columns if c.startswith("max_")]
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *fences)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), length=2048, end_id=1)
    return packed.drop("ids")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.learn_profiles(language_id.training_rows(docs))
    found = language_id.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "distance")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality_classifier.scored(docs, labels, fold() != 0, cut=0.3)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = class_lm.learned_and_scored(docs, fold() != 1)
    return found.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The rules of op6: verdict, host and path.
URL_RULES = [
    url_filters.Rule("allow", "com", "/"),
    url_filters.Rule("block", "example.com", "/en/"),
    url_filters.Rule("allow", "www.example.com", "/en/"),
    url_filters.Rule("block", "net", "/es/"),
    url_filters.Rule("block", "net", "/fr/"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400, passages_over=50)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "n_passages",
        "n_passage_words",
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "is_first", "class_size", "n_copies", "n_links")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), window=13, share=0.05)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=(5, 2, 1), share=1.5, most=2.0)
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), block=100, heads=6)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0, scale=256.0, positives=5, negatives=3, window=(50, 95))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h,
         max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, payload_bytes,
       translate(to_base(CAST('0x' || h[1:10] AS BIGINT), 32, 8) || to_base(CAST('0x' || h[11:20] AS BIGINT), 32, 8)
              || to_base(CAST('0x' || h[21:30] AS BIGINT), 32, 8) || to_base(CAST('0x' || h[31:40] AS BIGINT), 32, 8),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM d
"""


OP9_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths)),
hits AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (
  SELECT rid, count(DISTINCT pos) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


#: CRC-32 bit by bit: a byte of the id is mixed in (256 and over), then eight shifts (0).
OP12_SQL = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, count(*) AS n,
         xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[256 + ascii(x), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] FOR x IN string_split(CAST(c AS VARCHAR), '')])),
             lambda a, x: CASE WHEN x > 0 THEN xor(a, x - 256) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
  FROM turns GROUP BY c),
sized AS (SELECT a.c, a.h, a.c - a.c % 100 AS base, least(a.h, coalesce(b.n, 0)) AS b, least(a.h, coalesce(b.n, 0)) + greatest(a.n - a.h, 0) AS len FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 100),
seq AS (
  SELECT t.c, s.b + t.pos - s.h AS d, role, text FROM turns t JOIN sized s USING (c) WHERE pos > h
  UNION ALL SELECT s.c, t.pos, role, text FROM sized s JOIN turns t ON t.c = s.base AND t.pos <= s.b),
keyed AS (SELECT c, d, sha256(strlen(role) || ':' || role || text) AS k, length(text) AS chars FROM seq),
named AS (
  SELECT c, d, string_agg(k, ',') OVER (PARTITION BY c ORDER BY d) AS p, chars FROM keyed
  UNION ALL SELECT c, 0, '', 0 FROM sized),
linked AS (SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS parent FROM named),
nodes AS (SELECT p, d, min(c) AS first, count(*) AS n, any_value(parent) AS parent, max(chars) AS chars FROM linked GROUP BY p, d),
kids AS (SELECT parent AS p, count(*) AS k FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (p)),
totals AS (
  SELECT a.p, count(*) FILTER (k = 0) AS n_leaves, sum((n - 1) * f.chars) AS saved FROM full_nodes f JOIN named a ON a.c = f.first AND a.d <= f.d GROUP BY 1),
ends AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM named JOIN sized USING (c) WHERE d = len GROUP BY 1)
SELECT f.first AS conv_id, CAST(f.d AS BIGINT) AS depth, q.first AS parent_conv_id, f.n AS n_convs, f.k AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes f LEFT JOIN full_nodes q ON q.p = f.parent JOIN totals t ON t.p = f.p LEFT JOIN ends e ON e.p = f.p
"""


OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, a.label AS l, r.vec_id AS b, r.label, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM r a, r WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM s WHERE l = label AND a <> b),
g AS (
  SELECT p.a, p.b AS positive, p.score AS positive_score, s.b AS negative, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS n
  FROM p JOIN s ON s.a = p.a AND s.label <> s.l AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.n <= 5)
SELECT a AS anchor_id, positive AS positive_id, CAST(n AS INTEGER) AS rank, negative AS negative_id, positive_score, negative_score FROM g WHERE n <= 3
"""


def queries() -> dict:
    found = (op1_quality_rules, op2_packing, op3_language_id, op4_quality_classifier, op5_class_lm, op6_url_filters, op7_suffix_array_dedup, op8_minhash_near_dedup, op9_decontamination, op10_warc_revisits, op11_mixing, op12_prefix_trie, op13_hard_negatives)
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_decontamination": OP9_SQL, "op10_warc_revisits": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op13_hard_negatives": OP13_SQL}
