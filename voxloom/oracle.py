"""SQL for the queries of ``queries.py``, in DuckDB's dialect."""

from __future__ import annotations

from .queries import mel_weights
from .sources.models import MODELS

_TIMELINE = """
tl AS (
  SELECT conv_id, turn, role, text, 10 * length(text) AS len,
         coalesce(sum(10 * length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base
  FROM conversations),
seg AS (
  SELECT conv_id AS file_id, turn AS seg_no, text, base - 300 * (turn % 2) AS s, base - 300 * (turn % 2) + len AS e FROM tl),
trn AS (
  SELECT conv_id AS file_id, base + 900 * (turn % 3) AS s, base + 900 * (turn % 3) + len - 400 AS e,
         CASE WHEN role = 'user' THEN 0 ELSE 1 END AS speaker
  FROM tl WHERE role IN ({roles}))"""
_DOMINANT = """
ov AS (
  SELECT seg.file_id, seg.{key}, speaker, sum(least(seg.e, trn.e) - greatest(seg.s, trn.s)) AS o
  FROM {seg} AS seg JOIN trn ON seg.file_id = trn.file_id AND least(seg.e, trn.e) > greatest(seg.s, trn.s) GROUP BY ALL),
best AS (SELECT file_id, {key}, arg_max(speaker, {{'a': o, 'b': -speaker}}) AS speaker FROM ov GROUP BY file_id, {key})"""


def _dominant(roles: str = "'user', 'assistant'") -> str:
    return f"""WITH {_TIMELINE.format(roles=roles)}, {_DOMINANT.format(key='seg_no', seg='seg')}
SELECT seg.file_id, seg.seg_no, best.speaker FROM seg LEFT JOIN best ON seg.file_id = best.file_id AND seg.seg_no = best.seg_no"""


_SPOKEN = f"""WITH {_TIMELINE.format(roles="'user', 'assistant'")}, {_DOMINANT.format(key='seg_no', seg='seg')},
before AS (
  SELECT *, coalesce(max(greatest(0, s, e)) OVER (PARTITION BY file_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM seg),
sane AS (
  SELECT before.file_id, before.seg_no, text, greatest(s, 0, b) AS s, greatest(e, s, 0, b) AS e, speaker,
         row_number() OVER (PARTITION BY before.file_id ORDER BY before.seg_no) AS n
  FROM before LEFT JOIN best ON before.file_id = best.file_id AND before.seg_no = best.seg_no)"""


def _clock(c: str, mark: str) -> str:
    return f"printf('%02d:%02d:%02d{mark}%03d', {c} // 3600000, ({c} // 60000) % 60, ({c} // 1000) % 60, {c} % 1000)"


def _rendered(line: str, head: str = "''") -> str:
    return f"{_SPOKEN} SELECT file_id, {head} || string_agg({line}, '' ORDER BY seg_no) AS content FROM sane GROUP BY file_id"


_NAMED = "coalesce('Speaker ' || (speaker + 1) || ': ', '') || text"
_LABEL = "coalesce(printf('SPEAKER_%02d', speaker), '')"
_FRAMES = """
fr AS (
  SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value,
         CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS cluster
  FROM events)"""
_START = "greatest(round_even(({}) / (10::DOUBLE / 589) - 0.5, 0), 0)::INT"
_ACTIVITY = f"""{_FRAMES},
act AS (
  SELECT DISTINCT file_id, floor(value)::INT % 4 AS chunk_no, (frame * 7 % 589)::INT AS frame_no, cluster % 3 AS local_spk FROM fr),
files AS (SELECT DISTINCT file_id FROM fr),
chunks AS (SELECT file_id, unnest(range(0, 4))::INT AS chunk_no FROM files),
cov AS (
  SELECT file_id, {_START.format('chunk_no::DOUBLE')} + f AS frame, count(*) AS w
  FROM (SELECT file_id, chunk_no, unnest(range(0, 589))::INT AS f FROM chunks) GROUP BY ALL),
onn AS (SELECT file_id, {_START.format('chunk_no::DOUBLE')} + frame_no AS frame, count(*) AS o FROM act GROUP BY ALL),
grid AS (SELECT file_id, unnest(range(0, {_START.format('13::DOUBLE')} + 1))::INT AS frame FROM files),
cnt AS (
  SELECT file_id, frame, coalesce(round_even(o / w, 0), 0)::INT AS n
  FROM grid LEFT JOIN cov USING (file_id, frame) LEFT JOIN onn USING (file_id, frame)),
lab AS (
  SELECT file_id, chunk_no, l AS local_spk, CASE WHEN chunk_no % 2 = 0 AND l = 2 THEN 0 ELSE l END AS cluster
  FROM (SELECT file_id, chunk_no, unnest([0, 1, 2]) AS l FROM chunks)),
sup AS (
  SELECT file_id, {_START.format('chunk_no::DOUBLE')} + frame_no AS frame, cluster, count(*) AS support
  FROM (SELECT DISTINCT file_id, chunk_no, frame_no, cluster FROM act JOIN lab USING (file_id, chunk_no, local_spk)) GROUP BY ALL)"""
_TURNS = f"""{_FRAMES},
sizes AS (SELECT file_id, count(*) AS total FROM fr GROUP BY file_id),
isl AS (SELECT *, frame - row_number() OVER (PARTITION BY file_id, cluster ORDER BY frame) AS r FROM fr),
runs AS (SELECT file_id, cluster, min(frame) AS a, max(frame) AS z FROM isl GROUP BY file_id, cluster, r),
trn AS (
  SELECT file_id, cluster, (a + 0.5)::DOUBLE * 10 / 589 AS s, (least(z + 1, total - 1) + 0.5)::DOUBLE * 10 / 589 AS e FROM runs JOIN sizes USING (file_id)),
firsts AS (SELECT file_id, cluster, min({{'s': s, 'e': e, 'c': cluster}}) AS f FROM trn GROUP BY file_id, cluster),
ren AS (
  SELECT trn.file_id, s, e, speaker
  FROM trn JOIN (SELECT file_id, cluster, (dense_rank() OVER (PARTITION BY file_id ORDER BY f) - 1)::INT AS speaker FROM firsts) AS k
    ON trn.file_id = k.file_id AND trn.cluster = k.cluster)"""
_VEC = "v AS (SELECT vec_id, vec_id % 5 AS file_id, label AS cluster, embedding::DOUBLE[] AS e FROM embeddings)"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"
_COS = f"CASE WHEN {_DOT.format('{0}', '{0}')} = 0 OR {_DOT.format('{1}', '{1}')} = 0 THEN 1.0 ELSE 1 - {_DOT} / (sqrt({_DOT.format('{0}', '{0}')}) * sqrt({_DOT.format('{1}', '{1}')})) END"


def _centers(source: str, key: str) -> str:
    return f"""
parts AS (SELECT file_id, cluster, unnest(range(1, len({key}) + 1)) AS i, unnest({key}) AS x FROM {source}),
centers AS (SELECT file_id, cluster, list(m ORDER BY i) AS c FROM (SELECT file_id, cluster, i, avg(x) AS m FROM parts GROUP BY ALL) GROUP BY file_id, cluster)"""


_LAG = "r AS (SELECT vec_id, v, lag(v) OVER w AS b, lag(vec_id) OVER w AS other_id FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY vec_id))"
_WAVE = "list_sum(list_transform(range(0, 64), lambda n: e[n + 1] * {f}(2 * pi() / 64 * k * n)))"
_POWER = f"sp AS (SELECT vec_id, k, pow({_WAVE.format(f='cos')}, 2) + pow({_WAVE.format(f='sin')}, 2) AS p FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(0, 32)) AS k FROM embeddings))"
_BANKS = "[" + ", ".join("[" + ", ".join(f"{x:.6f}::DOUBLE" for x in row) + "]" for row in mel_weights()) + "]"
_RESULTS = """res AS (
  SELECT o_orderkey AS name, round(o_totalprice * 100)::BIGINT / 4.0::DOUBLE AS duration, (o_orderkey % 7)::DOUBLE AS wall,
         CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS outcome
  FROM orders)"""
_PATHS = """p AS (
  SELECT page_id, '/in/' || (page_id % 3) || '/' || regexp_extract(url, '([^/]*)$', 1) || '.' ||
         ['wav', 'MP3', 'flac', 'txt', 'Ogg', 'm4a', 'pdf', 'M4B', '', 'wav.bak'][page_id % 10 + 1] AS path
  FROM pages)"""
_MACHINES = """mach AS (
  SELECT p_partkey, p_size::BIGINT * 1073741824 AS ram, p_partkey % 9 AS jobs, CASE WHEN p_partkey % 2 = 0 THEN 268435456 ELSE 0 END AS extra FROM part),
reg(model, file, size, multilingual, can_translate, rank) AS (VALUES """ + ", ".join(f"('{m[0]}', '{m[1]}', {m[2]}::BIGINT, {m[4]}, {m[5]}, {m[6] or 'NULL'})" for m in MODELS) + """),
need AS (
  SELECT *, size + size // 2 + 1073741824 * greatest(jobs, 1) + extra AS need, ram * 85 // 100 AS budget FROM mach, reg)"""


def _human(c: str) -> str:
    """Tenths with ties to even, in whole numbers."""
    out = f"{c} || ' B'"
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        d = 1024**k
        whole, over = f"({c} // {d}::BIGINT)", f"(({c} % {d}::BIGINT) * 10)"
        tenths, rest = f"({whole} * 10 + {over} // {d}::BIGINT)", f"(({over} % {d}::BIGINT) * 2)"
        t = f"({tenths} + CASE WHEN {rest} > {d} OR ({rest} = {d} AND {tenths} % 2 = 1) THEN 1 ELSE 0 END)"
        out = f"CASE WHEN {c} >= {d} THEN ({t} // 10) || '.' || ({t} % 10) || ' {unit}' ELSE {out} END"
    return out


_STEM = "regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '(?s)^(.+)\\.[^.]*$', '\\1')"

SQL: dict[str, str] = {
    "segments_from_conversations": f"""WITH {_TIMELINE.format(roles="'user'")}, t AS (
  SELECT file_id, seg_no, s, e, regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS text FROM seg)
SELECT file_id, seg_no, s AS start_ms, e AS end_ms, length(text) AS n_chars FROM t WHERE text <> ''""",
    "no_speech_filter": """SELECT event_id, event_type AS text, (event_id * 100)::DOUBLE / 100 AS start, (event_id * 100 + 50)::DOUBLE / 100 AS "end"
FROM events WHERE NOT ((value / 500)::REAL > 0.6::REAL)""",
    "dominant_speaker_segments": _dominant(),
    "dominant_speaker_bins": _dominant(),
    "dominant_speaker_none": _dominant("'assistant'"),
    "dominant_speaker_words": f"""WITH {_TIMELINE.format(roles="'user', 'assistant'")},
parts AS (SELECT file_id, seg_no, s, e, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM seg),
wd AS (
  SELECT file_id, seg_no, k AS word_no, w[k + 1] AS word, s + (e - s) * k // len(w) AS s, s + (e - s) * (k + 1) // len(w) AS e, seg_no * 1000000 + k AS key
  FROM (SELECT *, unnest(range(0, len(w))) AS k FROM parts)),
{_DOMINANT.format(key='key', seg='wd')}
SELECT wd.file_id, wd.seg_no, wd.word_no::INT AS word_no, wd.word, best.speaker FROM wd LEFT JOIN best ON wd.file_id = best.file_id AND wd.key = best.key""",
    "sanitize_timestamps": """WITH n AS (
  SELECT user_id AS file_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg_no, round(value * 10)::BIGINT AS v FROM events),
seg AS (SELECT file_id, seg_no, seg_no * 1000 - v AS s, seg_no * 1000 - v + 2500 - v % 4000 AS e FROM n),
b AS (
  SELECT *, coalesce(max(greatest(0, s, e)) OVER (PARTITION BY file_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM seg)
SELECT file_id, seg_no, greatest(s, 0, b) AS start_ms, greatest(e, s, 0, b) AS end_ms FROM b""",
    "txt_lines": _rendered(f"{_NAMED} || chr(10)"),
    "srt_cues": _rendered(f"n || chr(10) || {_clock('s', ',')} || ' --> ' || {_clock('e', ',')} || chr(10) || {_NAMED} || chr(10) || chr(10)"),
    "vtt_cues": _rendered(
        f"{_clock('s', '.')} || ' --> ' || {_clock('e', '.')} || chr(10) || coalesce('<v Speaker ' || (speaker + 1) || '>', '') || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || chr(10)",
        "'WEBVTT' || chr(10) || chr(10)",
    ),
    "tsv_rows": _rendered(f"s || chr(9) || e || chr(9) || text || chr(9) || {_LABEL} || chr(10)", "'start' || chr(9) || 'end' || chr(9) || 'text' || chr(9) || 'speaker' || chr(10)"),
    "tsv_rows_plain": _rendered("s || chr(9) || e || chr(9) || text || chr(10)", "'start' || chr(9) || 'end' || chr(9) || 'text' || chr(10)"),
    "csv_rows": _rendered(f"s || ',' || e || ',\"' || replace(text, '\"', '\"\"') || '\",' || {_LABEL} || chr(10)", "'start,end,text,speaker' || chr(10)"),
    "json_document_fields": f"""{_SPOKEN} SELECT file_id, 1 AS schema_version, 'stub' AS model, 'en' AS language, (n - 1)::INT AS at,
  round(s / 1000.0, 3)::DOUBLE AS start, round(e / 1000.0, 3)::DOUBLE AS "end", text, printf('SPEAKER_%02d', speaker) AS speaker FROM sane""",
    "group_words": """WITH t AS (
  SELECT conv_id AS file_id, turn AS seg_no, unnest(range(0, len(x))) AS k, unnest(x) AS text FROM (SELECT conv_id, turn, regexp_extract_all(text, ' ?[^ ]{1,4}') AS x FROM conversations)),
m AS (SELECT file_id, seg_no, k, CASE WHEN k % 11 = 3 THEN '[_BEG_]' WHEN k % 13 = 5 THEN ' ' ELSE text END AS text FROM t),
kept AS (SELECT * FROM m WHERE NOT (starts_with(text, '[') AND ends_with(text, ']')) AND regexp_replace(text, '[\\s\\p{Z}]+', '', 'g') <> ''),
o AS (SELECT *, CASE WHEN starts_with(text, ' ') OR row_number() OVER (PARTITION BY file_id, seg_no ORDER BY k) = 1 THEN 1 ELSE 0 END AS opens FROM kept),
w AS (SELECT *, (sum(opens) OVER (PARTITION BY file_id, seg_no ORDER BY k) - 1)::INT AS word_no FROM o)
SELECT file_id, seg_no, word_no, min(k * 10)::DOUBLE / 100 AS start, max(k * 10 + 8)::DOUBLE / 100 AS "end",
       regexp_replace(string_agg(text, '' ORDER BY k), '^[\\s\\p{Z}]+', '') AS text
FROM w GROUP BY file_id, seg_no, word_no""",
    "normalize_language": """WITH a AS (SELECT doc_id, lang, [upper(lang), ' ', 'AUTO', NULL, lang || ' '][doc_id % 5 + 1] AS asked FROM documents),
n AS (SELECT doc_id, lang, CASE WHEN trim(asked) <> '' THEN lower(asked) END AS normalized FROM a)
SELECT doc_id, normalized, coalesce(CASE WHEN normalized <> 'auto' THEN normalized END, lang) AS reported FROM n""",
    "speaker_labels": """WITH r AS (SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY role) - 1 AS s FROM conversations)
SELECT conv_id, turn, printf('SPEAKER_%02d', s) AS label, 'Speaker ' || (s + 1) AS name FROM r""",
    "timestamps": f"""WITH t AS (SELECT event_id, round(value * 100)::BIGINT * 250 - 60000 AS m FROM events), c AS (SELECT event_id, m, greatest(m, 0) AS p FROM t)
SELECT event_id, {_clock('p', ',')} AS srt, {_clock('p', '.')} AS vtt, m AS ms FROM c""",
    "hopping_windows_full_tail": """WITH f AS (SELECT user_id AS file_id, (max(event_id) - min(event_id) + round(sum(value))::BIGINT) * 100 AS n_samples FROM events GROUP BY user_id),
c AS (SELECT *, CASE WHEN n_samples < 160000 THEN 1 ELSE (n_samples - 160000) // 16000 + 1 + CASE WHEN (n_samples - 160000) % 16000 <> 0 THEN 1 ELSE 0 END END AS n FROM f)
SELECT file_id, n_samples, k::INT AS chunk_no, k * 16000 AS start_sample FROM (SELECT *, unnest(range(0, n)) AS k FROM c)""",
    "frame_grid": f"""SELECT event_id, {_START.format('value')} AS frame, {_START.format('(floor(value) + 1)::DOUBLE')} AS chunk_start, {_START.format('10 + (floor(value) + 1)::DOUBLE - 1')} + 1 AS n_frames FROM events""",
    "frame_speaker_count": f"WITH {_ACTIVITY} SELECT file_id, n, count(*) AS frames, sum(frame)::BIGINT AS sum_frames FROM cnt GROUP BY file_id, n",
    "cluster_support": f"WITH {_ACTIVITY} SELECT * FROM sup",
    "topk_by_row_limit": f"""WITH {_ACTIVITY}, width AS (SELECT file_id, greatest(3, max(n)) AS w FROM cnt GROUP BY file_id),
g AS (SELECT file_id, frame, n, unnest(range(0, w))::INT AS cluster FROM cnt JOIN width USING (file_id)),
r AS (SELECT g.*, row_number() OVER (PARTITION BY file_id, frame ORDER BY coalesce(support, 0) DESC, cluster) AS r FROM g LEFT JOIN sup USING (file_id, frame, cluster))
SELECT file_id, frame, cluster FROM r WHERE r <= n""",
    "turns_gaps_islands": f'WITH {_TURNS} SELECT file_id, cluster, round(s, 6) AS start, round(e, 6) AS "end" FROM trn',
    "turns_renumbered": f'WITH {_TURNS} SELECT file_id, speaker, round(s, 6) AS start, round(e, 6) AS "end" FROM ren',
    "speaker_talk_time": f"WITH {_TURNS} SELECT file_id, speaker, round(sum(e - s), 6) AS seconds, count(*) AS turns FROM ren GROUP BY file_id, speaker",
    "powerset_argmax": """WITH a AS (SELECT vec_id, list_position(embedding[1:7], list_max(embedding[1:7])) - 1 AS k FROM embeddings)
SELECT vec_id, k AS class, k IN (1, 4, 5) AS spk0, k IN (2, 4, 6) AS spk1, k IN (3, 5, 6) AS spk2 FROM a""",
    "overlap_free_mask": f"""WITH {_FRAMES},
b AS (SELECT file_id, frame, floor(value / 2)::INT % 2 = 0 AS a0, floor(value / 3)::INT % 3 = 0 AS a1, floor(value / 4)::INT % 4 = 0 AS a2 FROM fr),
l AS (SELECT file_id, frame, k AS speaker, [a0, a1, a2][k + 1] AS f, a0::INT + a1::INT + a2::INT AS n FROM (SELECT *, unnest([0, 1, 2]) AS k FROM b)),
c AS (SELECT file_id, speaker, count(*) FILTER (f AND n < 2) AS clean FROM l GROUP BY ALL)
SELECT l.file_id, l.speaker, string_agg((CASE WHEN clean > 10 THEN f AND n < 2 ELSE f END)::INT::VARCHAR, '' ORDER BY frame) AS mask
FROM l JOIN c ON l.file_id = c.file_id AND l.speaker = c.speaker GROUP BY l.file_id, l.speaker""",
    "nearest_upsample": """SELECT vec_id, i::INT AS i, least(i * 64 // (vec_id % 40 + 64), 63)::INT AS src FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i FROM embeddings)""",
    "l2_normalize": f"""WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT *, sqrt({_DOT.format('v', 'v')}) AS n FROM a)
SELECT vec_id, i::INT AS i, round(CASE WHEN n = 0 THEN 0 ELSE v[i + 1] / n END, 6) AS x FROM (SELECT *, unnest(range(0, len(v))) AS i FROM n)""",
    "cosine_neighbours": f"WITH {_LAG} SELECT vec_id, other_id, round({_COS.format('v', 'b')}, 6) AS cosine FROM r WHERE b IS NOT NULL",
    "euclidean_neighbours": f"WITH {_LAG} SELECT vec_id, other_id, round(sqrt(list_sum(list_transform(list_zip(v, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS euclidean FROM r WHERE b IS NOT NULL",
    "centroids_raw_mean": f"WITH {_VEC}, {_centers('v', 'e')} SELECT file_id, cluster, (i - 1)::INT AS i, round(avg(x), 6) AS x FROM parts GROUP BY file_id, cluster, i",
    "nearest_centroid": f"""WITH {_VEC}, {_centers('v', 'e')},
d AS (SELECT v.file_id, v.vec_id, centers.cluster AS k, {_COS.format('v.e', 'centers.c')} AS d FROM v JOIN centers ON v.file_id = centers.file_id)
SELECT file_id, vec_id, arg_min(k, {{'d': d, 'k': k}}) AS nearest FROM d GROUP BY file_id, vec_id""",
    "absorb_small_clusters": f"""WITH {_VEC},
u AS (SELECT file_id, cluster, list_transform(e, lambda x: x / n) AS w FROM (SELECT *, sqrt({_DOT.format('e', 'e')}) AS n FROM v)),
{_centers('u', 'w')},
sz AS (SELECT file_id, cluster, count(*) AS n FROM v GROUP BY ALL), lst AS (SELECT file_id, ceil(avg(n)) AS least FROM sz GROUP BY file_id),
al AS (SELECT centers.file_id, centers.cluster, c, n, least FROM centers JOIN sz ON centers.file_id = sz.file_id AND centers.cluster = sz.cluster JOIN lst ON centers.file_id = lst.file_id),
d AS (SELECT a.file_id, a.cluster, b.cluster AS k, {_COS.format('a.c', 'b.c')} AS d FROM al AS a JOIN al AS b ON a.file_id = b.file_id AND b.n >= b.least),
near AS (SELECT file_id, cluster, arg_min(k, {{'d': d, 'k': k}}) AS near FROM d GROUP BY ALL)
SELECT al.file_id, al.cluster, CASE WHEN n >= least THEN al.cluster ELSE coalesce(near, 0) END AS absorbed FROM al LEFT JOIN near ON al.file_id = near.file_id AND al.cluster = near.cluster""",
    "power_spectrum_64": f"WITH {_POWER} SELECT vec_id, k::INT AS k, round(p, 6) AS power FROM sp",
    "mel_energy": f"""WITH {_POWER}, l AS (SELECT vec_id, list(p ORDER BY k) AS p FROM sp GROUP BY vec_id), b AS (SELECT vec_id, p, unnest(range(0, 8)) AS band, unnest({_BANKS}) AS w FROM l)
SELECT vec_id, band::INT AS band, round(ln(greatest({_DOT.format('p', 'w')}, 1.1920929e-07)), 6) AS energy FROM b""",
    "cmn": """WITH p AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, i::INT AS i, round(x - avg(x) OVER (PARTITION BY label, i), 6) AS x FROM p""",
    "downmix_stereo": """SELECT vec_id, i::INT AS i, round((e[2 * i + 1] + e[2 * i + 2]) / 2, 9) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(0, len(embedding) // 2)) AS i FROM embeddings)""",
    "resample_length": """WITH n AS (SELECT event_id, round(value * 100)::BIGINT AS n, [8000, 16000, 44100, 48000][event_id % 4 + 1] AS r FROM events)
SELECT event_id, (n * 16000 + r - 1) // r AS n_out, (n * 16000 + r - 1) // r > 20000 AS too_long FROM n""",
    "discover_by_extension": f"""WITH {_PATHS}, s AS (SELECT page_id, path, {_STEM} AS stem FROM p
  WHERE lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) IN ('wav', 'mp3', 'flac', 'ogg', 'oga', 'm4a', 'mp4', 'm4b'))
SELECT page_id, path, stem, regexp_extract(path, '(?s)^(.*)/[^/]*$', 1) || '/' || stem || '.srt' AS beside, '/out/' || stem || '.srt' AS in_out_dir FROM s""",
    "collision_check": """WITH o AS (SELECT page_id AS i, regexp_extract(url, '([^/?#.]*)[^/]*$', 1) AS x FROM pages),
k AS (SELECT i, CASE WHEN i % 2 = 0 THEN upper(x) ELSE x END AS o FROM o),
r AS (SELECT i, o, lower(o) AS folded, row_number() OVER (PARTITION BY lower(o) ORDER BY i) AS n FROM k)
SELECT a.folded, a.i AS first_input, b.i AS second_input, a.o AS first_output, b.o AS second_output, a.o = b.o AS same_case FROM r AS a JOIN r AS b ON a.folded = b.folded AND a.n = 1 AND b.n = 2""",
    "up_to_date_outputs": "SELECT o_orderkey AS path, bool_and(coalesce(l_shipdate >= o_orderdate, FALSE)) AS fresh FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "stale_inputs_anti": "SELECT o_orderkey AS path FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING NOT bool_and(coalesce(l_shipdate >= o_orderdate, FALSE))",
    "batch_summary": f"""WITH {_RESULTS} SELECT count(*) FILTER (outcome = 'done') AS done, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed,
  coalesce(sum(duration) FILTER (outcome = 'done'), 0) AS audio, coalesce(sum(wall) FILTER (outcome = 'done'), 0) AS wall FROM res""",
    "batch_exit_code": f"""WITH {_RESULTS}, b AS (SELECT name % 50 AS batch, count(*) FILTER (outcome = 'failed') AS failed, count(*) AS processed FROM res GROUP BY 1)
SELECT batch, failed, processed, CASE WHEN failed > 0 THEN 20 WHEN batch % 2 = 0 AND processed < 320 THEN 20 ELSE 0 END AS exit_code FROM b""",
    "file_outcomes": """WITH e AS (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'skip' WHEN event_id % 13 = 0 THEN 'failed' ELSE 'pcm' END AS status,
         CASE WHEN event_id % 7 = 1 THEN 'run: ' || event_type END AS run, CASE WHEN event_id % 5 = 2 THEN 'speakers: ' || event_type END AS spk,
         CASE WHEN event_id % 17 = 3 THEN 'write: ' || event_type END AS wr FROM events)
SELECT event_id, CASE WHEN status = 'skip' THEN 'skipped' WHEN status = 'failed' OR coalesce(run, spk, wr) IS NOT NULL THEN 'failed' ELSE 'done' END AS outcome,
       CASE WHEN status = 'pcm' THEN coalesce(run, wr, 'diarization failed: ' || spk || '; transcript saved without speakers') END AS reason FROM e""",
    "report_lines": f"""WITH {_RESULTS} SELECT name, CASE outcome
  WHEN 'done' THEN 'ok  [en] ' || printf('%.1f', duration) || 's in ' || printf('%.1f', wall) || 's (' || CASE WHEN wall > 0 THEN printf('%.1f', duration / wall) || '×RT' ELSE '—' END || ') → /out/' || name || '.srt'
  WHEN 'skipped' THEN 'skip  up to date' ELSE 'fail  code ' || (name % 3) END AS line FROM res""",
    "realtime_factor": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN printf('%.1f', l_quantity / (l_linenumber * 8)::DOUBLE) || '×RT' END AS speed FROM lineitem""",
    "largest_fitting_model": f"""WITH {_MACHINES} SELECT p_partkey, coalesce(arg_min(model, rank) FILTER (rank IS NOT NULL AND need <= budget), 'tiny') AS model FROM need GROUP BY p_partkey""",
    "memory_guard": f"""WITH {_MACHINES} SELECT p_partkey, model, need, need > budget AS refused, greatest(greatest(budget - size - size // 2 - extra, 0) // 1073741824, 1) AS max_jobs FROM need""",
    "model_registry": f"WITH {_MACHINES} SELECT model, file, size, multilingual, can_translate, {_human('size')} AS human FROM reg",
    "repetition_loop": """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS text FROM documents) SELECT doc_id, text, count(*) AS n FROM l GROUP BY doc_id, text HAVING count(*) > 2""",
    "sha256_text": "SELECT doc_id, sha256(text) AS sha256, TRUE AS same FROM documents",
    "human_size": f"""WITH s AS (SELECT doc_id, n_chars * [1, 49, 2401, 117649, 5764801, 282475249, 13841287201][doc_id % 7 + 1] AS size FROM documents) SELECT doc_id, size, {_human('size')} AS human FROM s""",
    "error_rows": """SELECT event_id, [10, 14, 1, 16, 17, NULL][event_id % 6 + 1] AS code, CASE event_id % 6
  WHEN 0 THEN 'cannot decode /in/' || event_id || ': ' || event_type || '. Convert it to WAV, or use the external decoder.'
  WHEN 1 THEN 'no such file or directory: /in/' || event_id WHEN 2 THEN 'I/O error: ' || event_type WHEN 3 THEN 'transcription failed: ' || event_type
  WHEN 4 THEN 'speaker diarization failed: ' || event_type END AS message FROM events""",
    "activity_by_hour": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
