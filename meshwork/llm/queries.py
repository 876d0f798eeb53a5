"""The operators' queries over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import bpe_round_trip
from .exact_dedup import exact_dedup
from .language_id import language_id
from .line_dedup import line_dedup
from .media import media_columns
from .near_dedup import QUERY, near_groups
from .packing import best_fit_packing
from .span_dedup import span_dedup
from .token_counts import token_counts
from .url_filter import filter_urls

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": _over("documents", line_dedup),
        "op2_minhash_near_dedup": _over("documents", lambda docs: near_groups(docs, QUERY)),
        "op3_url_filters": _over("pages", filter_urls),
        "op4_token_counts": _over("documents", token_counts),
        "op5_substring_dedup": _over("documents", span_dedup),
        "op6_language_id": _over("documents", language_id),
        "op7_media_columns": _over("documents", media_columns),
        "op8_best_fit_packing": _over("documents", best_fit_packing),
        "op9_bpe_round_trip": _over("documents", bpe_round_trip),
        "op10_exact_dedup": _over("documents", exact_dedup),
    }


EXACT_DEDUP_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


LINE_DEDUP_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS body FROM parts),
counted AS (SELECT *, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS w FROM lines),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM counted),
runs AS (SELECT a.doc_id, a.line AS first, z.line AS last FROM summed a JOIN summed z ON a.doc_id = z.doc_id AND a.line <= z.line
         WHERE z.upto - a.upto + a.w >= 8 AND (z.upto - z.w - a.upto + a.w < 8 OR z.upto - a.upto < 8)),
copies AS (SELECT r.doc_id, first, last, row_number() OVER (PARTITION BY array_to_string(l[first + 1:last + 1], chr(10)) ORDER BY r.doc_id, first) AS copy FROM runs r JOIN parts p ON p.doc_id = r.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS line FROM copies WHERE copy > 1),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed, string_agg(CASE WHEN g.line IS NULL THEN l.body END, chr(10) ORDER BY l.line) AS body
         FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.body, '') END AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

NEAR_DEDUP_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
groups AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN groups g ON g.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP_SQL, "op2_minhash_near_dedup": NEAR_DEDUP_SQL, "op10_exact_dedup": EXACT_DEDUP_SQL}
