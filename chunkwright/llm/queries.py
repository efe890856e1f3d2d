"""Queries over the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkwright.llm.html_wrappers import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def fold(modulus: int):
    """The remainder of crc32(doc_id as text)."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkwright.llm.toxicity import assess, fit

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, _table(spark, sf_dir, "labels"), fold(3) != 1)
    return assess(docs, model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkwright.llm.decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkwright.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM r
"""


def op5_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkwright.llm.sstable import token_tables

    return token_tables(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkwright.llm.quality import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkwright.llm.suffix_dedup import removals

    return removals(_table(spark, sf_dir, "documents"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkwright.llm.order_minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkwright.llm.langid import fit, identify

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, fold(4) != 2)
    return identify(docs, model).select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkwright.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkwright.llm.hard_negatives import mine, scaled

    return mine(scaled(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH e AS (SELECT row_number() OVER () AS tag, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.tag, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                  list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda k: a.v[k] * b.v[k]))::BIGINT AS score
           FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id IS DISTINCT FROM a.vec_id),
     p AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY score DESC, id NULLS LAST) AS place FROM s WHERE same),
     n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.tag, p.place ORDER BY s.score DESC, s.id NULLS LAST) AS rank
           FROM p JOIN s ON s.tag = p.tag AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE place <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkwright.llm.prefix_trie import trie, with_family_heads

    return trie(with_family_heads(_table(spark, sf_dir, "conversations")))


OP12_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
     z AS (SELECT c, c::VARCHAR AS s, max(i) AS n FROM t GROUP BY 1),
     k AS (SELECT c, n, c - c % 100 AS fam, xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * strlen(s))), lambda crc, j:
             xor(xor(crc, CASE WHEN j % 8 = 0 THEN ord(substr(s, (j // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT) >> 1, 3988292384::BIGINT * (xor(crc, CASE WHEN j % 8 = 0 THEN ord(substr(s, (j // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT) & 1))), 4294967295::BIGINT) % 6 AS h FROM z),
     f AS (SELECT k.c, k.fam, k.h, least(k.h, coalesce(r.n, 0)) AS b FROM k LEFT JOIN k r ON r.c = k.fam),
     r AS (SELECT f.c, i AS d, role, text FROM f JOIN t ON t.c = f.fam AND i <= f.h UNION ALL SELECT f.c, i - h + b, role, text FROM f JOIN t ON t.c = f.c AND i > f.h),
     p AS (SELECT c, d, length(text) AS chars, list((role, text)) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS seq FROM r),
     m AS (SELECT c, d, chars, min(c) OVER (PARTITION BY seq) AS o, count(*) OVER (PARTITION BY seq) AS n FROM p
           UNION ALL SELECT c, 0, 0, min(c) OVER (), count(*) OVER () FROM k),
     x AS (SELECT o, d, max(n) AS n, max((n - 1) * chars) AS own FROM m GROUP BY 1, 2),
     q AS (SELECT x.*, m.o AS parent FROM x LEFT JOIN m ON m.c = x.o AND m.d = x.d - 1),
     ch AS (SELECT parent AS o, d - 1 AS d, count(*) AS kids FROM q WHERE parent IS NOT NULL GROUP BY 1, 2),
     y AS (SELECT q.*, coalesce(kids, 0) AS kids FROM q LEFT JOIN ch USING (o, d)),
     u AS (SELECT m.o, m.d, sum(own) AS saved, sum((kids = 0)::INT) AS leaves FROM y JOIN m ON m.c = y.o AND m.d <= y.d GROUP BY 1, 2),
     l AS (SELECT c, max(d) AS d FROM m GROUP BY 1),
     e AS (SELECT m.o, m.d, string_agg(m.c::VARCHAR, ',' ORDER BY m.c) AS ids FROM m JOIN l USING (c, d) GROUP BY 1, 2)
SELECT o AS conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n::BIGINT AS n_convs, kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM y JOIN u USING (o, d) LEFT JOIN e USING (o, d)
"""


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkwright.llm.pii import KINDS, find, fit

    docs = _table(spark, sf_dir, "documents")
    found = find(docs, fit(docs), ["doc_id"])

    def number(kind: str):  # noqa: ANN202
        return F.size(F.filter("fixed", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):  # noqa: ANN001, ANN202
        placed = F.transform(spans, lambda s: F.struct(s["begin"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["end"], s["kind"]))
        return F.array_join(F.transform(F.array_sort(placed), lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")

    return found.select("doc_id", *map(number, KINDS[:4]), F.sha2(joined("fixed").cast("binary"), 256).alias("base_sha256"), joined(F.concat("fixed", "added")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_wrappers": op1_html_wrappers,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_token_tables": op5_token_tables,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_order_minhash": op8_order_minhash,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_pii": op13_pii,
}

ORACLE_SQL: dict[str, str] = {"op4_warc_round_trip": OP4_SQL, "op11_hard_negatives": OP11_SQL, "op12_prefix_trie": OP12_SQL}
