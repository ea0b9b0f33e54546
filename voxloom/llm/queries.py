"""Queries of this subpackage, ``(spark, sf_dir) -> DataFrame``, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .shared import read_table


def op1_decontaminate(spark, sf_dir):
    from .decontaminate import decontaminate

    out = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    items = F.col("items")
    return out.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


def op2_repeats(spark, sf_dir):
    from .repeats import repeat_digest

    return repeat_digest(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    from .simhash import simhash_groups

    return simhash_groups(read_table(spark, sf_dir, "documents"))


def op4_neighbours(spark, sf_dir):
    from .neighbours import search_all

    return search_all(read_table(spark, sf_dir, "embeddings"))


def op5_html_text(spark, sf_dir):
    from .html_text import extract_text

    return extract_text(read_table(spark, sf_dir, "pages"))


def op6_mix_sources(spark, sf_dir):
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    from .warc import warc_round_trip

    return warc_round_trip(read_table(spark, sf_dir, "pages")).drop("url")


def op8_line_dedup(spark, sf_dir):
    from .line_dedup import drop_repeated_lines

    out = drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_token_files(spark, sf_dir):
    from .token_files import token_output

    return token_output(read_table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    from .cotraining import quality

    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_repeats, op3_simhash, op4_neighbours, op5_html_text, op6_mix_sources, op7_warc, op8_line_dedup, op9_token_files, op10_quality)}

#: A-Z to a-z, as SQL.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The words of a text, as SQL.
_WORDS = "list_filter(string_split_regex(" + _LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

SQL = {
    "op1_decontaminate": f"""
WITH items AS (
  SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (
  SELECT item_id, w, least(len(w), 13) AS n FROM items WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
docs AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wins) AS sizes WHERE len(w) >= n)),
found AS (
  SELECT spots.doc_id, spots.n, spots.i, wins.item_id FROM spots JOIN wins ON spots.n = wins.n AND spots.win = wins.win),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
by_doc AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit ON docs.doc_id = hit.doc_id LEFT JOIN by_doc ON docs.doc_id = by_doc.doc_id
""",
    "op2_repeats": """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
wins AS (
  SELECT doc_id, i, md5(b[i:i + 399]) AS h
  FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM docs WHERE octet_length(b) >= 400)),
twice AS (SELECT h FROM wins GROUP BY h HAVING count(*) > 1),
starts AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, TRUE) AS fresh
  FROM wins WHERE h IN (SELECT h FROM twice)),
runs AS (
  SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi
  FROM (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM starts) GROUP BY doc_id, k),
gaps AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS before FROM runs),
pieces AS (
  SELECT gaps.doc_id, lo, hex(b[before:lo - 1]) AS piece, hi - lo AS n FROM gaps JOIN docs USING (doc_id)
  UNION ALL
  SELECT docs.doc_id, octet_length(b) + 2, hex(b[coalesce(last_hi, 1):octet_length(b)]), 0
  FROM docs LEFT JOIN (SELECT doc_id, max(hi) AS last_hi FROM runs GROUP BY doc_id) USING (doc_id))
SELECT doc_id, any_value(octet_length(b))::BIGINT AS n_bytes, sum(n)::BIGINT AS n_removed, count(*) FILTER (n > 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(string_agg(piece, '' ORDER BY lo), ''))) AS kept_sha256
FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id
""",
    "op4_neighbours": """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
fine AS (
  SELECT vec_id, e FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
sized AS (
  SELECT * FROM fine WHERE len(e) = (SELECT len(e) FROM fine GROUP BY len(e) ORDER BY count(*) DESC, len(e) LIMIT 1)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM sized AS q JOIN sized AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op7_warc": """
WITH keyed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT n, h, min(page_id) AS first_id FROM keyed GROUP BY n, h),
bits AS (
  SELECT page_id, n, h, array_to_string(list_transform(range(1, 41), lambda i: list_extract(
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'],
    strpos('0123456789abcdef', substr(h, i, 1)))), '') AS b
  FROM keyed)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(b, 5 * k + 1, 1)::INT + 8 * substr(b, 5 * k + 2, 1)::INT + 4 * substr(b, 5 * k + 3, 1)::INT
           + 2 * substr(b, 5 * k + 4, 1)::INT + substr(b, 5 * k + 5, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM bits JOIN firsts USING (n, h)
""",
    "op8_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines),
dup AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT keyed.*, dup.k IS NOT NULL AND keyed.doc_id <> dup.first_id AS gone FROM keyed LEFT JOIN dup ON keyed.k = dup.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
