"""DuckDB SQL with the results of the queries in :mod:`corpusloom.catalog`.

Written against the definitions, not the plans: long tables, cross products
and windows where Spark uses arrays, in-row counts and range partitions.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

DOCUMENTS = "SELECT doc_id, lang AS label, text FROM documents"
SOURCES = "SELECT doc_id, source AS label, text FROM documents WHERE source LIKE 'src%'"
ROLES = "SELECT conv_id || ':' || turn AS doc_id, role AS label, text FROM conversations"

BY_NAME = "SELECT label, CAST(row_number() OVER (ORDER BY label) AS INTEGER) AS code FROM docs GROUP BY label"
SOURCE_CODES = (
    "SELECT 'src' || s AS label, CAST(row_number() OVER (ORDER BY s) AS INTEGER) AS code "
    "FROM (SELECT unnest(range(20)) AS s UNION ALL SELECT 99)"
)


def plogp(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE {x} * log2({x}) END)"


def corpus(docs: str = DOCUMENTS, codes: str = BY_NAME) -> str:
    """Token, count and category tables."""
    return rf"""WITH docs AS ({docs}),
tok AS (SELECT doc_id, label, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM docs),
tf AS (SELECT doc_id, label, term, count(*) AS tf FROM tok GROUP BY ALL),
codes AS ({codes}),
cls AS (SELECT code, label, count(doc_id) AS n_docs FROM codes LEFT JOIN docs USING (label) GROUP BY ALL),
tot AS (SELECT sum(n_docs)::DOUBLE AS n FROM cls),
ent AS (SELECT sum({plogp('n_docs / n')}) AS entropy FROM cls, tot),
lt AS (SELECT term, label, count(*) AS a, sum(tf)::BIGINT AS tf FROM tf GROUP BY ALL),
cand AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) > 1 AND length(term) > 1),
ids AS (SELECT row_number() OVER (ORDER BY term) AS id, term, df FROM cand)"""


def scored(docs: str = DOCUMENTS, codes: str = BY_NAME) -> str:
    """... and scores. chi: one row per term and class; scores: one per term."""
    return f"""{corpus(docs, codes)},
cells AS (
  SELECT id, term, df, code, n_docs, n, entropy, coalesce(a, 0) AS a, coalesce(tf, 0) AS tf
  FROM ids CROSS JOIN cls CROSS JOIN tot CROSS JOIN ent LEFT JOIN lt USING (term, label)),
square AS (
  SELECT *, a::DOUBLE AS va, (df - a)::DOUBLE AS vb, (n_docs - a)::DOUBLE AS vc, n - n_docs - (df - a) AS vd FROM cells),
parts AS (
  SELECT *, n * (va * vd - vc * vb) * (va * vd - vc * vb) AS top,
         (va + vb) * (va + vc) * (vb + vd) * (vc + vd) AS bottom FROM square),
chi AS (
  SELECT *, CASE WHEN top > 0 AND bottom > 0 THEN top / bottom ELSE 0.0::DOUBLE END AS x FROM parts),
scores AS (
  SELECT id, term, df,
         -any_value(entropy) + (df / any_value(n)) * sum({plogp('a / n')} ORDER BY code)
           + ((any_value(n) - df) / any_value(n)) * sum({plogp('(n_docs - a) / n')} ORDER BY code) AS ig,
         stddev_pop(x ORDER BY code) AS chi, var_pop(x ORDER BY code) AS chi_variance
  FROM chi GROUP BY id, term, df),
dict AS (SELECT *, ig * chi AS score FROM scores WHERE NOT (ig * chi < 0.01::DOUBLE))"""


def weighted(extra: str = "") -> str:
    """... and document weights in both scales."""
    return f"""{scored()},
w AS (
  SELECT doc_id, label, term, id, tf, sqrt(tf)::FLOAT::DOUBLE * score AS w FROM tf JOIN dict USING (term)),
ends AS (
  SELECT *, min(w) OVER (PARTITION BY doc_id) AS lo, max(w) OVER (PARTITION BY doc_id) AS hi FROM w),
mm AS (SELECT doc_id, label, id, CASE WHEN hi = lo THEN w ELSE (w - lo) / (hi - lo) END AS w FROM ends),
mx AS (
  SELECT doc_id, label, id,
         CASE WHEN greatest(hi, 0) = least(lo, 0) THEN w
              ELSE (w - least(lo, 0)) / (greatest(hi, 0) - least(lo, 0)) END AS w FROM ends),
ranked AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS r,
         count(*) OVER (PARTITION BY label) AS n_label FROM docs),
split AS (
  SELECT doc_id, label, CASE WHEN r <= floor(n_label * 0.6::DOUBLE) THEN 'train' ELSE 'test' END AS split
  FROM ranked){extra}"""


PACK = "string_agg(id || ':' || CAST(round(w * 1e6) AS BIGINT), ' ' ORDER BY id)"
CONTENT = "html"
for pattern in (
    r"(?is)<script\b.*?</script\s*>",
    r"(?is)<style\b.*?</style\s*>",
    r"(?s)<!--.*?-->",
    r"(?s)<[^>]*>",
    r"&#?[A-Za-z0-9]+;",
    r"\s+",
):
    CONTENT = f"regexp_replace({CONTENT}, '{pattern}', ' ', 'g')"
CONTENT = f"trim({CONTENT})"
URL = "CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN url ELSE 'http://' || url END"

ORACLE["corpus_scan"] = DOCUMENTS
ORACLE["label_index"] = f"{corpus()} SELECT code, label FROM cls"
ORACLE["label_index_roundtrip"] = ORACLE["label_index"]
ORACLE["page_scan"] = "SELECT page_id, url, html FROM pages"

DICTIONARY_ROWS = f"""{scored()} SELECT id, term, df, round(ig, 6) AS ig, round(chi, 6) AS chi, round(score, 6) AS score,
  (SELECT n::BIGINT FROM tot) AS n, (SELECT max(id) FROM ids) AS max_id FROM dict"""
ORACLE["dict_roundtrip"] = DICTIONARY_ROWS
ORACLE["dict_text_roundtrip"] = DICTIONARY_ROWS

TOLD = "id IN (SELECT id FROM dict)"
ORACLE["class_tf_file"] = f"{scored()} SELECT id, code, tf FROM cells WHERE {TOLD}"
ORACLE["class_chi_file"] = f"{scored()} SELECT id, code, round(x, 6) AS chi FROM chi WHERE {TOLD}"

SPLIT_SUMS = """ SELECT split, code, id, count(*) AS docs, round(sum(w), 6) AS w
  FROM mm JOIN split USING (doc_id, label) JOIN cls USING (label) {where} GROUP BY ALL"""
ORACLE["sparse_roundtrip"] = weighted() + SPLIT_SUMS.format(where="")
ORACLE["libsvm_roundtrip"] = weighted() + SPLIT_SUMS.format(where="WHERE w <> 0")

ORACLE["one_class_roundtrip"] = f"""{weighted()} SELECT label, split, CAST(1 AS INTEGER) AS code,
  count(DISTINCT doc_id) AS docs, count(*) AS features FROM mm JOIN split USING (doc_id, label) GROUP BY ALL"""
ORACLE["default_gamma"] = f"""{weighted()} SELECT max(id) AS max_id, 1 / max(id)::DOUBLE AS gamma
  FROM mm JOIN split USING (doc_id, label) WHERE split = 'train'"""

ORACLE["url_normalize"] = f"SELECT page_id, {URL} AS url FROM pages"
ORACLE["url_normalize_http_only"] = (
    "SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN url ELSE 'http://' || url END AS url FROM pages"
)
ORACLE["html_to_text"] = f"SELECT page_id, {CONTENT} AS content FROM pages"
ORACLE["tokenize"] = rf"""WITH t AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS terms FROM documents)
SELECT doc_id, unnest(range(1, len(terms) + 1)) AS pos, unnest(terms) AS term FROM t"""
ORACLE["term_freq"] = f"{corpus()} SELECT doc_id, label, term, tf FROM tf"

ORACLE["category_doc_count"] = f"{corpus()} SELECT code, label, n_docs FROM cls"
ORACLE["category_doc_count_configured"] = f"{corpus(SOURCES, SOURCE_CODES)} SELECT code, label, n_docs FROM cls"
ORACLE["doc_freq"] = f"{corpus()} SELECT term, count(*) AS df FROM tf GROUP BY term"
ORACLE["category_term_freq"] = f"{corpus()} SELECT label, term, tf FROM lt"
ORACLE["contingency"] = f"{corpus()} SELECT term, label, a FROM lt"
ORACLE["candidate_terms"] = f"{corpus()} SELECT term, df FROM cand"
ORACLE["feature_ids"] = f"{corpus()} SELECT id, term, df FROM ids"
ORACLE["category_tf_matrix"] = f"{scored()} SELECT id, term, code, tf FROM cells"

ORACLE["class_entropy"] = f"{corpus()} SELECT n::BIGINT AS n, round(entropy, 6) AS entropy FROM tot, ent"
ORACLE["info_gain"] = f"{scored()} SELECT term, round(ig, 6) AS ig FROM scores"
ORACLE["chi_square"] = f"{scored()} SELECT term, code, round(x, 6) AS chi FROM chi"
ORACLE["chi_dispersion"] = (
    f"{scored()} SELECT term, round(chi, 6) AS chi, round(chi_variance, 4) AS chi_variance FROM scores"
)
ORACLE["term_score"] = (
    f"{scored()} SELECT term, df, round(ig, 6) AS ig, round(chi, 6) AS chi, round(ig * chi, 6) AS score FROM scores"
)
SELECTED = "SELECT id, term, df, round(score, 6) AS score FROM dict"
ORACLE["selected_terms"] = f"{scored()} {SELECTED}"
ORACLE["selected_terms_by_source"] = f"{scored(SOURCES, SOURCE_CODES)} {SELECTED}"
ORACLE["selected_terms_by_role"] = f"{scored(ROLES)} {SELECTED}"
ORACLE["dictionary_order"] = f"{scored()} SELECT id, term, round(score, 6) AS score FROM dict ORDER BY dict.score DESC, id"
ORACLE["top_terms"] = f"""{scored()} SELECT id, term, df, round(ig, 6) AS ig, round(chi, 6) AS chi,
  round(dict.score, 6) AS score FROM dict ORDER BY dict.score DESC, id LIMIT 100"""

ORACLE["doc_term_weight"] = f"{weighted()} SELECT doc_id, term, id, tf, round(w, 6) AS w FROM w"
ORACLE["weights_minmax"] = f"{weighted()} SELECT doc_id, id, round(w, 6) AS w FROM mm"
ORACLE["weights_minmax_shuffled"] = ORACLE["weights_minmax"]
ORACLE["weights_max"] = f"{weighted()} SELECT doc_id, id, round(w, 6) AS w FROM mx"
ORACLE["doc_vectors"] = f"{weighted()} SELECT doc_id, label, {PACK} AS vector FROM mm GROUP BY ALL"
ORACLE["split_vectors"] = (
    f"{weighted()} SELECT doc_id, label, split, {PACK} AS vector FROM mm JOIN split USING (doc_id, label) GROUP BY ALL"
)
ORACLE["page_vectors"] = rf"""{scored()},
content AS (SELECT page_id, {URL} AS page_url, {CONTENT} AS content FROM pages),
page_tok AS (
  SELECT page_id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')) AS term FROM content),
page_w AS (
  SELECT page_id, id, sqrt(count(*))::FLOAT::DOUBLE * score AS w FROM page_tok JOIN dict USING (term)
  GROUP BY page_id, id, score),
page_mx AS (
  SELECT page_id, id, CASE WHEN max(w) OVER p = 0 THEN w ELSE w / max(w) OVER p END AS w
  FROM page_w WINDOW p AS (PARTITION BY page_id)),
packed AS (SELECT page_id, {PACK} AS vector FROM page_mx GROUP BY page_id)
SELECT page_id, page_url AS url, coalesce(vector, '') AS vector FROM content LEFT JOIN packed USING (page_id)"""
HASHED = """CASE WHEN ('0x' || substr(md5(label || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.6::DOUBLE
  THEN 'train' ELSE 'test' END"""
ORACLE["train_test_split_hashed"] = f"SELECT doc_id, label, {HASHED} AS split FROM ({DOCUMENTS})"
ORACLE["split_vectors_hashed"] = f"{weighted()} SELECT doc_id, label, {HASHED} AS split, {PACK} AS vector FROM mm GROUP BY ALL"

# The frequencies of a feature: 64-bit counters, mixed modulo 2^64 in 128 bits, two uniforms to a pair of normals.
DIMS, SEED, GAMMA = 128, 42, 0.125
MASK = "18446744073709551615::UHUGEINT"


def mixed(z: str) -> str:
    """Uniforms of (0, 1) from the counters ``z``, next to their columns."""
    return f"""m1 AS (SELECT * EXCLUDE z, (z * 11400714819323198485::UHUGEINT) & {MASK} AS z FROM {z}),
m2 AS (SELECT * EXCLUDE z, (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) & {MASK} AS z FROM m1),
m3 AS (SELECT * EXCLUDE z, (xor(z, z >> 27) * 10723151780598845931::UHUGEINT) & {MASK} AS z FROM m2),
uniforms AS (SELECT * EXCLUDE z, ((xor(z, z >> 31) >> 11)::DOUBLE + 0.5::DOUBLE) / 9007199254740992::DOUBLE AS u FROM m3)"""


KERNEL = f"""{weighted()},
steps AS (
  SELECT id, step, (id::UHUGEINT * {DIMS}::UHUGEINT + {SEED}::UHUGEINT * 13787848793156543929::UHUGEINT + step::UHUGEINT) & {MASK} AS z
  FROM (SELECT DISTINCT id FROM mm), (SELECT unnest(range(1, {DIMS} + 1)) AS step)),
{mixed("steps")},
pairs AS (
  SELECT id, step - 1 AS lane, sqrt(-2.0::DOUBLE * ln(u)) AS radius, 2.0::DOUBLE * pi() * angle AS angle
  FROM uniforms JOIN (SELECT id, step - {DIMS} // 2 AS step, u AS angle FROM uniforms WHERE step > {DIMS} // 2) USING (id, step)),
freq AS (
  SELECT id, lane AS dim, radius * cos(angle) AS f FROM pairs UNION ALL
  SELECT id, lane + {DIMS} // 2, radius * sin(angle) FROM pairs),
projected AS (SELECT doc_id, dim, sum(w * f) AS value FROM mm JOIN freq USING (id) GROUP BY ALL)"""
ORACLE["kernel_projections"] = f"{KERNEL} SELECT doc_id, dim::INTEGER AS dim, round(value, 4) AS value FROM projected"
ANGLE = f"value * sqrt({2 * GAMMA}::DOUBLE)"
ORACLE["kernel_features"] = f"""{KERNEL}
  SELECT doc_id, dim::INTEGER AS dim, round(cos({ANGLE}) / sqrt({DIMS}::DOUBLE), 4) AS value FROM projected UNION ALL
  SELECT doc_id, (dim + {DIMS})::INTEGER, round(sin({ANGLE}) / sqrt({DIMS}::DOUBLE), 4) FROM projected"""
ORACLE["train_test_split"] = f"{weighted()} SELECT doc_id, label, split FROM split"

QUALITY = """WITH codes AS (SELECT * FROM (VALUES (1, '0'), (2, '1'), (3, '2')) AS v(code, label)),
pairs AS (SELECT quality::VARCHAR AS label, toxic::VARCHAR AS prediction FROM labels),
conf AS (
  SELECT code, label,
         (SELECT count(*) FROM pairs p WHERE p.label = codes.label AND p.prediction = codes.label) AS a,
         (SELECT count(*) FROM pairs p WHERE p.label = codes.label AND p.prediction <> codes.label) AS b,
         (SELECT count(*) FROM pairs p WHERE p.label <> codes.label AND p.prediction = codes.label) AS c
  FROM codes),
rp AS (
  SELECT *, CASE WHEN a = 0 THEN 0 ELSE a / (a + b)::DOUBLE END AS r,
         CASE WHEN a + c = 0 THEN 0 ELSE a / (a + c)::DOUBLE END AS p FROM conf),
met AS (
  SELECT code, label, r * 100 AS recall, p * 100 AS "precision",
         CASE WHEN r = 0 OR p = 0 THEN 0 ELSE 2 * p * r / (r + p) END AS fscore, a, b, c FROM rp),
own AS (
  SELECT code, label, count(prediction) AS b, count(*) FILTER (prediction = '0') AS a
  FROM codes LEFT JOIN pairs USING (label) GROUP BY ALL),
acc AS (SELECT code, label, CASE WHEN b = 0 THEN 0 ELSE a / b::DOUBLE END AS accuracy, a, b FROM own)"""
ORACLE["confusion"] = f"{QUALITY} SELECT code, label, a, b, c FROM conf"
ORACLE["class_metrics"] = f"""{QUALITY} SELECT code, label, round(recall, 6) AS recall,
  round("precision", 6) AS "precision", round(fscore, 6) AS fscore, a, b, c FROM met"""
ORACLE["overall_metrics"] = f"""{QUALITY} SELECT sum(a + b)::BIGINT AS total, sum(a)::BIGINT AS correct,
  round(sum(a) / sum(a + b)::DOUBLE, 6) AS accuracy, round(avg(recall), 6) AS mean_recall,
  round(avg("precision"), 6) AS mean_precision, round(avg(fscore), 6) AS mean_fscore FROM met"""
ORACLE["one_class_metrics"] = f"{QUALITY} SELECT code, label, round(accuracy, 6) AS accuracy, a, b FROM acc"


def short(x: str) -> str:
    return rf"regexp_replace(CAST(CAST({x} AS DECIMAL(18, 6)) AS VARCHAR), '\.?0+$', '')"


def padded(widths: tuple[int, ...], *cells: str) -> str:
    return " || ".join(
        f"({cell}) || repeat(' ', greatest(0, {width} - length({cell})))" for cell, width in zip(cells, widths)
    )


WIDE, SLIM = (30, 20, 20, 20, 20), (30, 15, 15)
RULE = "repeat('=', 79)"
ORACLE["report_lines"] = f"""{QUALITY},
sums AS (
  SELECT sum(a + b)::DOUBLE AS total, sum(a)::DOUBLE AS hit, avg(recall) AS mr, avg("precision") AS mp,
         avg(fscore) AS mf FROM met),
parts AS (
  SELECT 0 AS ord, {RULE} AS line UNION ALL
  SELECT 1, 'CORPUS:QUALITY' UNION ALL
  SELECT 2, {RULE} UNION ALL
  SELECT 3, {padded(WIDE, "'CATEGORY'", "'RECALL'", "'PRECISION'", "'FSCORE'", "'ABC'")} UNION ALL
  SELECT 3 + row_number() OVER (ORDER BY fscore DESC, code),
         {padded(WIDE, "'[' || lower(label) || ']'", short('recall'), short('"precision"'), short('fscore'),
                 "a || ' ' || b || ' ' || c")} FROM met UNION ALL
  SELECT 7, repeat('-', 45) UNION ALL
  SELECT 8, {padded(WIDE, "'ACCURACY:'", "(hit / total)::VARCHAR", "'total:' || total::VARCHAR",
                    "'true:' || hit::VARCHAR", "'false:' || (total - hit)::VARCHAR")} FROM sums UNION ALL
  SELECT 9, {padded(WIDE, "'MEAN-RECALL:'", short('mr'))} FROM sums UNION ALL
  SELECT 10, {padded(WIDE, "'MEAN-PRECISION:'", short('mp'))} FROM sums UNION ALL
  SELECT 11, {padded(WIDE, "'MEAN-FSCORE:'", short('mf'))} FROM sums UNION ALL
  SELECT 12, {padded(WIDE, "'COST:'", "'32.0'")} UNION ALL
  SELECT 13, {padded(WIDE, "'GAMMA:'", "'0.125'")})
SELECT CAST(ord AS INTEGER) AS ord, line FROM parts"""
ORACLE["report_file"] = f"SELECT line, 2 * count(*) AS n FROM ({ORACLE['report_lines']}) GROUP BY line"
ORACLE["one_class_report_lines"] = f"""{QUALITY},
parts AS (
  SELECT 0 AS ord, {RULE} AS line UNION ALL
  SELECT 1, 'CORPUS:QUALITY' UNION ALL
  SELECT 2, {RULE} UNION ALL
  SELECT 3, {padded(SLIM, "'CATEGORY'", "'ACCURACY'", "'AB'")} UNION ALL
  SELECT 3 + row_number() OVER (ORDER BY accuracy DESC, code),
         {padded(SLIM, "'[' || upper(label) || ']'", short('accuracy'), "a || ' ' || b")} FROM acc UNION ALL
  SELECT 7, ' ' UNION ALL
  SELECT 8, {padded(SLIM, "'ACCURACY:'", short('avg(accuracy)'))} FROM acc)
SELECT CAST(ord AS INTEGER) AS ord, line FROM parts"""

# What is exact about the models needs no model.
PART = "SELECT DISTINCT doc_id, label FROM mm JOIN split USING (doc_id, label) WHERE split = '{part}'"
HELD_OUT = PART.format(part="test")
ORACLE["svm_known_labels"] = f"{weighted()} SELECT doc_id, label, true AS known FROM ({HELD_OUT})"
ORACLE["svm_class_rows"] = f"{weighted()} SELECT label, count(*) AS docs FROM ({HELD_OUT}) GROUP BY label"
ORACLE["model_roundtrip_same"] = f"{weighted()} SELECT doc_id, label, true AS same FROM ({HELD_OUT})"
ORACLE["one_class_refusals"] = (
    f"{weighted()} SELECT label, count(*) AS docs, true AS within FROM ({PART.format(part='train')}) GROUP BY label"
)
ORACLE["classify_pages_known"] = f"SELECT page_id, {URL} AS url, true AS known FROM pages"
ORACLE["classify_pages_twice"] = f"SELECT page_id, {URL} AS url, 2 * count(*) AS n FROM pages GROUP BY ALL"
ORACLE["classify_multi_rows"] = f"SELECT page_id, {URL} AS url, true AS labelled FROM pages"
ORACLE["classify_stream_same"] = f"SELECT page_id, {URL} AS url, true AS same FROM pages"
ORACLE["one_class_gamma"] = f"""{weighted()} SELECT label, 1 / max(id)::DOUBLE AS gamma
  FROM mm JOIN split USING (doc_id, label) WHERE split = 'train' GROUP BY label"""
ORACLE["one_class_roundtrip_same"] = ORACLE["model_roundtrip_same"]
ORACLE["label_line_file"] = f"SELECT {URL} AS url, count(*) AS n, true AS known FROM pages GROUP BY ALL"
