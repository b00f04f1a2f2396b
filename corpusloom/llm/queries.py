"""One query per operator over the given tables, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    chat, decontaminate, html, langid, licenses, negatives, packing, pitman_yor, simhash, substring, vectors, warc, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_chat_windows(spark, sf_dir):
    """Every conversation formatted and read back, and one whose texts are control strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", words), (-1, 1, "assistant", words)], given.schema)
    windows = chat.format_conversations(given.unionByName(planted))
    return chat.read_back(windows)


@query
def op2_language_profiles(spark, sf_dir):
    """Languages of all documents from profiles of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn_profiles(docs.where(~langid.held_out()), "text", "lang")
    texts = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict_languages(texts, profiles).select("doc_id", "held_out", "lang_pred", "score")


@query
def op3_simhash_groups(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_warc_bundles(spark, sf_dir):
    """All pages written to bundles, then read back from the archives."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = warc.write_archive(pages)
    kind = pages.schema["page_id"].dataType
    return warc.read_archive(spark, archive, content=False).select(
        F.when(F.col("key") != "\\N", F.col("key")).cast(kind).alias("page_id"),
        "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )


@query
def op5_html_main_text(spark, sf_dir):
    return html.extract_main_text(table(spark, sf_dir, "pages"))


@query
def op6_benchmark_passages(spark, sf_dir):
    """Documents that hold benchmark passages, with their items and places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("passages") > 0).select(
        "doc_id", F.array_sort(F.array_distinct("passages.item_id")).alias("item_ids"),
        F.size("passages").alias("n_passages"),
        F.transform("passages", lambda p: F.concat_ws("-", p["start"], p["end"])).alias("spans"),
    )


@query
def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_license_scan(spark, sf_dir):
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("dice", F.round("dice", 6))


@query
def op9_repeated_windows(spark, sf_dir):
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_embedding_groups(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_hard_negatives(spark, sf_dir):
    """Hard negatives after every seventh row has changed its label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


@query
def op13_pitman_yor_scores(spark, sf_dir):
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {
    "op4_warc_bundles": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest,
                   octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes
            FROM pages
        ), m AS (
            SELECT *, CASE WHEN payload_bytes >= 1000
                           THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS last
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN last <> page_id THEN last END AS refers_to
        FROM m
    """,
    "op9_repeated_windows": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), starts AS (
            SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS win
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)
        ), ordered AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM starts
        ), covered AS (
            SELECT DISTINCT doc_id, i + d AS i FROM ordered, range(20) AS r(d) WHERE nth > 1
        ), gone AS (
            SELECT doc_id, list(i) AS cut FROM covered GROUP BY doc_id
        ), kept AS (
            SELECT w.doc_id, len(words) AS n_words, len(coalesce(cut, [])) AS n_removed,
                   list_filter(words, lambda x, i: NOT list_contains(coalesce(cut, []), i)) AS k
            FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
        )
        SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
               sha256(array_to_string(k, ' ')) AS kept_sha256
        FROM kept
    """,
    "op10_embedding_groups": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        ), u AS (
            SELECT vec_id, e FROM v
            WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v
            UNION
            SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), c AS (
            SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
        ), n AS (
            SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
        )
        SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept
        FROM c LEFT JOIN n ON c.vec_id = n.vec_id
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                   list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
            WHERE a.vec_id % 50 = 0
        ), p AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        ), n AS (
            SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS nth
            FROM p JOIN s ON p.anchor_id = s.anchor_id
            WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        )
        SELECT anchor_id, positive_id, nth::INTEGER AS rank, negative_id, positive_score, negative_score
        FROM n WHERE nth <= 3
    """,
}
