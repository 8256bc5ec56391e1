"""SQL counterparts of the registered queries. They work on the relation behind the traces and never see a text
of a trace: Spark renders and parses, this side only counts."""

from __future__ import annotations

from reasonmill.functions.text import BLANKS as text_blanks
from reasonmill.operators import matching
from reasonmill.operators.corpus import PROMPT
from reasonmill import registry
from reasonmill.registry import UCIHAR_CLASSES, UCIHAR_SENSORS, UCIHAR_TERMS, dimension_rows
from reasonmill.sources import derived


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


CLASSES = _list(UCIHAR_CLASSES)
LABELS = _list([*UCIHAR_CLASSES, "unknown"])
SENSORS_LOWER = _list([s.lower() for s in derived.RAW_SENSORS])
CANONICAL = _list(["body_acc_x", "gyro_z", "total_acc_y", "body_acc_x", "heart_rate", "gyro_z"])
WINDOWS = _list(derived.WINDOWS)
PATTERNS = _list(derived.PATTERNS)
SYNTHESES = _list(derived.SYNTHESES)
BLANKS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANK_CHARS = " || ".join(f"chr({ord(c)})" for c in text_blanks)
VISIBLE = BLANKS.replace("[", "[^", 1)

RELATION = f"""
base AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders
), n AS (
  SELECT *, CAST(k AS VARCHAR) AS sample_id, (p + k) % 9 AS n_gt,
    greatest((p + k) % 9 - k % 3, 0) + c % 2 AS n_pred,
    (k + c) % 4 AS m_gt, (k + c + CASE WHEN c % 5 = 0 THEN 1 ELSE 0 END) % 4 AS m_pred,
    c % 19 NOT IN (0, 1) AS has_ref,
    c % 23 <> 0 AND NOT (n_pred = 0 AND m_pred = 0 AND (k + c) % 17 = 0 AND k % 13 = 1) AS has_gen,
    {CLASSES}[p % 6 + 1] AS gt_activity,
    CASE WHEN c % 23 = 0 OR k % 13 = 1 THEN 'unknown' WHEN c % 17 = 0 THEN 'break dancing'
      ELSE {CLASSES}[CASE WHEN c % 4 = 0 THEN (p + 1) % 6 ELSE p % 6 END + 1] END AS predicted_activity,
    CASE WHEN c % 23 = 0 OR k % 13 = 1 THEN NULL WHEN c % 17 = 0 THEN 'break dancing'
      ELSE {CLASSES}[CASE WHEN c % 4 = 0 THEN (p + 1) % 6 ELSE p % 6 END + 1]
        || CASE WHEN c % 2 = 0 THEN ' today' ELSE '' END END AS gen_activity,
    CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN 9 ELSE 1 END AS gt_syn,
    CASE WHEN (k + c) % 17 = 0 THEN NULL WHEN k % 7 = 0 THEN 9 ELSE 1 END AS pred_syn,
    k % 3 AS gt_syn_text, c % 3 AS pred_syn_text
  FROM base
), conf AS (SELECT 1), ref_obs AS (
  SELECT sample_id, k, c, i, i AS num, h % 6 AS s, (h // 6) % 7 AS w, (h // 42) % 3 AS q,
    CASE WHEN h % 5 = 0 THEN 'medium' WHEN i <= 3 THEN 'high' WHEN i <= 6 THEN 'moderate' ELSE 'low' END AS conf
  FROM (SELECT *, k * 7 + c * 13 + p + i * 37 AS h FROM n, unnest(range(1, n_gt + 1)) AS t(i)) WHERE has_ref
), gen_obs AS (
  SELECT sample_id, k, c, i, CASE WHEN k % 41 = 0 AND i > 1 THEN i - 1 ELSE i END AS num,
    (h + CASE WHEN (i + c) % 7 = 0 THEN 1 ELSE 0 END) % 6 AS s,
    (h // 6 + CASE WHEN (i + k) % 5 = 0 THEN 1 ELSE 0 END) % 7 AS w,
    (h // 42 + CASE WHEN (i + k + c) % 4 = 0 THEN 1 ELSE 0 END) % 3 AS q,
    CASE WHEN h % 5 = 0 THEN 'medium' WHEN i <= 3 THEN 'high' WHEN i <= 6 THEN 'moderate' ELSE 'low' END AS conf
  FROM (SELECT *, k * 7 + c * 13 + p + i * 37 AS h FROM n, unnest(range(1, n_pred + 1)) AS t(i)) WHERE has_gen
), ref_inf AS (
  SELECT sample_id, k, c, i, (k + i) % 8 + 1 AS a, (c + 3 * i) % 8 + 1 AS b, (k + i) % 10 = 0 AS lost,
    (k + c + i) % 4 AS t
  FROM n, unnest(range(1, m_gt + 1)) AS t(i) WHERE has_ref
), gen_inf_base AS (
  SELECT sample_id, k, c, i, (k + j) % 8 + 1 AS a, (c + 3 * j) % 8 + 1 AS b, (k + j) % 10 = 0 AS lost,
    (k + c + j) % 4 AS t
  FROM (SELECT *, CASE WHEN k % 4 = 0 AND i <= 2 THEN 3 - i ELSE i END AS j
        FROM n, unnest(range(1, m_pred + 1)) AS t(i)) WHERE has_gen
), gen_node AS (
  SELECT sample_id, num, {SENSORS_LOWER}[arg_max(s, i) + 1] AS sensor FROM gen_obs GROUP BY ALL
), gen_inf AS (
  SELECT x.*, CASE t WHEN 0 THEN 'the ' || coalesce(o.sensor, 'nothing') || ' signal moves'
      WHEN 1 THEN 'Motion in ' || replace(coalesce(o.sensor, 'nothing'), '_', ' ') || ' here'
      WHEN 2 THEN 'motion along z' ELSE 'calm and still' END AS text
  FROM gen_inf_base x LEFT JOIN gen_node o ON x.sample_id = o.sample_id AND x.a = o.num
), gen_cite AS (
  SELECT sample_id, i, unnest(CASE WHEN lost THEN [a, b, 99] ELSE [a, b] END) AS cited,
    unnest(CASE WHEN lost THEN [0, 1, 2] ELSE [0, 1] END) AS pos FROM gen_inf_base
), gen_check AS (
  SELECT x.sample_id, x.i, bool_and(o.num IS NOT NULL) AS structural,
    bool_or(coalesce(contains(lower(y.text), o.sensor) OR contains(lower(y.text), replace(o.sensor, '_', ' '))
      OR (string_split(o.sensor, '_')[-1] IN ('x', 'y', 'z')
          AND contains(lower(y.text), string_split(o.sensor, '_')[-1])), false)) AS names_sensor
  FROM gen_cite x JOIN gen_inf y ON x.sample_id = y.sample_id AND x.i = y.i
  LEFT JOIN gen_node o ON x.sample_id = o.sample_id AND x.cited = o.num GROUP BY ALL
), sized AS (
  SELECT *, CASE WHEN has_gen THEN n_pred ELSE 0 END AS gen_n, CASE WHEN has_ref THEN n_gt ELSE 0 END AS ref_n,
    CASE WHEN has_gen THEN m_pred ELSE 0 END AS gen_m, CASE WHEN has_ref THEN m_gt ELSE 0 END AS ref_m
  FROM n
)"""


def _on_relation(select: str, more: str = "") -> str:
    return f"WITH RECURSIVE {RELATION.strip()}{', ' + more.strip() if more else ''} {select}"


def _node(side: str, source: str) -> str:
    return f"""SELECT sample_id, '{side}' AS side, i - 1 AS pos, 'O' || num AS id,
      {SENSORS_LOWER}[s + 1] AS sensor, {WINDOWS}[w + 1] AS temporal, {PATTERNS}[q + 1] AS pattern,
      conf AS confidence FROM {source}"""


CHAIN = """
chain AS (
  SELECT z.sample_id, z.gt_activity,
    CASE WHEN gen_n > 0 AND gen_m > 0 THEN s END AS s, CASE WHEN gen_n > 0 AND gen_m > 0 THEN m END AS m
  FROM sized z LEFT JOIN (
    SELECT sample_id, avg(structural::INT) AS s, avg((structural AND names_sensor)::INT) AS m
    FROM gen_check GROUP BY ALL) USING (sample_id)
  WHERE has_ref
)"""
COVERAGE = """
ref_mean AS (
  SELECT gt_activity, avg(ref_n) AS mean FROM sized WHERE has_ref AND ref_n > 0 GROUP BY ALL
), gc AS (
  SELECT z.gt_activity, least(gen_n / mean, 1.0) AS gc, mean FROM sized z JOIN ref_mean USING (gt_activity)
  WHERE has_ref AND gen_n > 0
)"""
ATTRIBUTIONS = """
docs AS (
  SELECT *, CASE WHEN c % 31 = 0 THEN 'misc_' || k || '_v' || v || '.json'
    ELSE (CASE WHEN v = 1 THEN 'test' ELSE 'train' END) || '_class' || (p % 6) || '_'
      || ['Walking', 'WalkingUpstairs', 'WalkingDownstairs', 'Sitting', 'Standing', 'Laying'][p % 6 + 1]
      || '_s' || lpad(CAST(k AS VARCHAR), CAST(greatest(7, len(CAST(k AS VARCHAR))) AS INTEGER), '0') || '.json' END AS file_name,
    c % 31 <> 0 AS has_id, CASE WHEN c % 31 = 0 THEN 'unknown' WHEN v = 1 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN c % 31 = 0 THEN '0' ELSE sample_id END AS file_id
  FROM n, unnest(CASE WHEN k % 29 = 0 THEN [] WHEN k % 10 = 0 THEN [0, 1]
    WHEN c % 3 = 0 THEN [1] ELSE [0] END) AS t(v)
), regions AS (
  SELECT d.*, r, ['Acc_X', 'Gyro_Z', 'Total_Acc_Y', 'AccZ', 'Heart_Rate', ''][(p + k + r * 5 + v) % 6 + 1] AS raw,
    CASE WHEN (p * 3 + c + r * 7) % 11 <> 10 THEN (p * 3 + c + r * 7) % 11 / 100.0::DOUBLE END AS mean_importance,
    (p * 3 + c + r * 7) % 11 / 50.0::DOUBLE AS max_importance, (p + r * 29) % 128 AS start_t,
    (c + r * 17 + p % 50) % 110 + 1 AS length
  FROM docs d, unnest(range(1, (p // 7 + c + v) % 13 + 1)) AS t(r)
), evidence AS (
  SELECT *, start_t + length AS end_t, start_t + 1 AS peak_timestep,
    CASE WHEN raw = 'Acc_X' THEN 'body_acc_x' ELSE lower(raw) END AS sensor,
    CASE WHEN least((start_t + length) / 128.0, 1.0) - start_t / 128.0 >= 0.75 THEN 'full_window'
      ELSE CASE WHEN (least((start_t + length) / 128.0, 1.0) + start_t / 128.0) / 2 < 0.25 THEN 'early'
        WHEN (least((start_t + length) / 128.0, 1.0) + start_t / 128.0) / 2 < 0.4 THEN 'early_to_mid'
        WHEN (least((start_t + length) / 128.0, 1.0) + start_t / 128.0) / 2 < 0.6 THEN 'mid'
        WHEN (least((start_t + length) / 128.0, 1.0) + start_t / 128.0) / 2 < 0.75 THEN 'mid_to_late'
        ELSE 'late' END END AS "window",
    CASE WHEN r <= 3 THEN 'high' WHEN r <= 6 THEN 'moderate' ELSE 'low' END AS tier
  FROM regions WHERE r <= 10
), latest AS (
  SELECT sample_id, k, max(file_name) AS file_name FROM docs WHERE has_id GROUP BY ALL
), top AS (
  SELECT l.sample_id, raw, row_number() OVER (PARTITION BY l.sample_id ORDER BY coalesce(mean_importance, 0) DESC, r) AS place
  FROM latest l JOIN regions g ON l.k = g.k AND l.file_name = g.file_name
), important AS (
  SELECT DISTINCT sample_id, CASE raw WHEN 'Acc_X' THEN 'body_acc_x' WHEN 'AccZ' THEN 'body_acc_z'
    ELSE lower(raw) END AS sensor FROM top WHERE place <= 3 AND raw <> ''
)"""
GROUNDING = (
    ATTRIBUTIONS
    + f""", mentioned AS (
  SELECT DISTINCT sample_id, {SENSORS_LOWER}[s + 1] AS sensor FROM gen_obs
), gs AS (
  SELECT z.sample_id, gen_n = 0 AS parse_failed, any_value(i.n) AS ni, any_value(m.n) AS nm,
    count(x.sensor) AS shared
  FROM sized z
  LEFT JOIN (SELECT sample_id, count(*) AS n FROM important GROUP BY ALL) i USING (sample_id)
  LEFT JOIN (SELECT sample_id, count(*) AS n FROM mentioned GROUP BY ALL) m USING (sample_id)
  LEFT JOIN (SELECT sample_id, sensor FROM important INTERSECT SELECT sample_id, sensor FROM mentioned) x
    USING (sample_id)
  WHERE has_ref GROUP BY z.sample_id, gen_n
), scores AS (
  SELECT sample_id, parse_failed, CASE WHEN ni > 0 AND nm > 0 THEN shared / nm END AS gs_precision,
    CASE WHEN ni > 0 AND nm > 0 THEN shared / ni END AS gs_recall FROM gs
), gsf AS (
  SELECT *, CASE WHEN gs_precision + gs_recall = 0 THEN 0.0
    ELSE 2 * gs_precision * gs_recall / (gs_precision + gs_recall) END AS gs_f1 FROM scores
)"""
)

NODES = """
obs_n AS (
  SELECT sample_id, count(*) AS obs, sum((s IN (0, 1, 2))::INT) AS ok_sensor,
    sum((conf IN ('high', 'medium', 'low'))::INT) AS ok_conf, count(DISTINCT num) AS ids FROM gen_obs GROUP BY ALL
), inf_n AS (
  SELECT sample_id, count(*) AS inf, sum(structural::INT) AS st, sum(names_sensor::INT) AS sem
  FROM gen_check GROUP BY ALL
), cited AS (
  SELECT c.sample_id, count(DISTINCT c.cited) AS cited FROM gen_cite c
  JOIN gen_node o ON c.sample_id = o.sample_id AND c.cited = o.num GROUP BY ALL
), counts AS (
  SELECT z.*, o.*, coalesce(inf, 0) AS inf, coalesce(st, 0) AS st, coalesce(sem, 0) AS sem,
    coalesce(cited, 0) AS cited, gen_n > 0 AS ok
  FROM sized z LEFT JOIN obs_n o USING (sample_id) LEFT JOIN inf_n USING (sample_id) LEFT JOIN cited USING (sample_id)
  WHERE has_ref
)"""

MATCH = f"""
reason AS (
  SELECT *, CASE WHEN NOT has_ref THEN 'no_gt_reasoning' WHEN NOT has_gen THEN 'no_pred_text'
    WHEN n_gt = 0 THEN 'gt_parse_fail' WHEN n_pred = 0 THEN 'pred_parse_fail' END AS skip_reason FROM n
), live AS (SELECT * FROM reason WHERE skip_reason IS NULL),
go AS (SELECT r.*, {CANONICAL}[s + 1] AS ch FROM ref_obs r SEMI JOIN live USING (sample_id)),
po AS (SELECT r.*, {CANONICAL}[s + 1] AS ch FROM gen_obs r SEMI JOIN live USING (sample_id)),
obs_pair AS (
  SELECT g.sample_id, g.ch AS grp, g.i, p.i AS j, (g.w = p.w)::INT AS tm, g.w AS gw, p.w AS pw,
    CASE WHEN g.q = p.q AND abs(g.w - p.w) <= 1 THEN 'YES' WHEN (7 * g.i + p.i + g.k) % 29 = 0 THEN 'ERROR'
      WHEN (g.i + 2 * p.i + g.k) % 31 = 0 THEN NULL ELSE 'NO' END AS verdict
  FROM go g JOIN po p ON g.sample_id = p.sample_id AND g.ch = p.ch
), gi AS (SELECT * FROM ref_inf SEMI JOIN live USING (sample_id)),
pi AS (SELECT * FROM gen_inf_base SEMI JOIN live USING (sample_id)),
inf_pair AS (
  SELECT g.sample_id, '' AS grp, g.i, p.i AS j, 0 AS tm,
    CASE WHEN g.t = p.t AND (g.k + g.i + p.i) % 3 <> 0 THEN 'YES' WHEN (g.i + p.i + g.k) % 7 = 0 THEN 'ERROR'
      ELSE 'NO' END AS verdict
  FROM gi g JOIN pi p ON g.sample_id = p.sample_id
), syn_pair AS (
  SELECT sample_id, CASE WHEN gt_syn_text = pred_syn_text THEN 'YES' WHEN k % 9 = 0 THEN 'ERROR' ELSE 'NO' END AS verdict
  FROM live WHERE gt_syn IS NOT NULL AND pred_syn IS NOT NULL
)"""

# All assignments of every group, row by row; a skipped row counts as column 99 in the tie order.
SOLVE = (
    MATCH
    + """, pair AS (
  SELECT 'o' AS kind, sample_id, grp, i, j, tm, verdict,
    CASE verdict WHEN 'YES' THEN 0 WHEN 'ERROR' THEN 1 ELSE 2 END AS cost FROM obs_pair
  UNION ALL SELECT 'i', sample_id, grp, i, j, tm, verdict,
    CASE verdict WHEN 'YES' THEN 0 WHEN 'NO' THEN 2 ELSE 1 END FROM inf_pair
), local AS (
  SELECT *, dense_rank() OVER (PARTITION BY kind, sample_id, grp ORDER BY i) AS r,
    dense_rank() OVER (PARTITION BY kind, sample_id, grp ORDER BY j) AS x FROM pair
), size AS (SELECT kind, sample_id, grp, max(r) AS rows, max(x) AS cols FROM local GROUP BY ALL),
step AS (
  SELECT kind, sample_id, grp, r, x, tm, cost, 1::BIGINT << x AS bit FROM local
  UNION ALL SELECT DISTINCT l.kind, l.sample_id, l.grp, l.r, 99, 0, 0, 0::BIGINT
  FROM local l JOIN size s ON l.kind = s.kind AND l.sample_id = s.sample_id AND l.grp = s.grp WHERE rows > cols
),
walk AS (
  SELECT kind, sample_id, grp, rows, cols, 0::BIGINT AS r, 0::BIGINT AS mask, 0::BIGINT AS cost, 0::BIGINT AS hits,
    0::BIGINT AS bonus, []::BIGINT[] AS path, 0::BIGINT AS skipped FROM size
  UNION ALL
  SELECT w.kind, w.sample_id, w.grp, w.rows, w.cols, w.r + 1, w.mask | l.bit, w.cost + l.cost,
    w.hits + (l.bit > 0 AND l.cost = 0)::INT, w.bonus + (l.bit > 0 AND l.cost = 0 AND l.tm = 1)::INT,
    list_append(w.path, l.x), w.skipped + (l.bit = 0)::INT
  FROM walk w JOIN step l ON w.kind = l.kind AND w.sample_id = l.sample_id AND w.grp = l.grp AND l.r = w.r + 1
  WHERE w.mask & l.bit = 0 AND w.skipped + (l.bit = 0)::INT <= greatest(w.rows - w.cols, 0)
), best AS (
  SELECT kind, sample_id, grp, arg_min(path, {'a': cost, 'b': -hits, 'c': -bonus, 'd': path}) AS path
  FROM walk WHERE r = rows GROUP BY kind, sample_id, grp
), chosen AS (
  SELECT l.* FROM best b JOIN local l ON b.kind = l.kind AND b.sample_id = l.sample_id AND b.grp = l.grp
    AND b.path[l.r] = l.x
)"""
)
OBS_MATCH = (
    SOLVE
    + """, om AS (
  SELECT c.sample_id, 'O' || g.num AS gt_id, 'O' || p.num AS pred_id, c.grp AS sensor, c.tm = 1 AS temporal_match,
    coalesce(c.verdict, 'UNMATCHED') AS judge_verdict, c.cost = 0 AS hit, c.cost / 2 AS cost, c.i,
    min(c.i) OVER (PARTITION BY c.sample_id, c.grp) AS first_i
  FROM chosen c JOIN go g ON c.sample_id = g.sample_id AND c.i = g.i
  JOIN po p ON c.sample_id = p.sample_id AND c.j = p.i WHERE c.kind = 'o'
  UNION ALL
  SELECT g.sample_id, 'O' || g.num, NULL, g.ch, false,
    CASE WHEN e.sample_id IS NULL THEN 'NO_PRED_COVERAGE' ELSE 'UNMATCHED' END, false, 1.0, g.i, NULL
  FROM go g ANTI JOIN (SELECT * FROM chosen WHERE kind = 'o') c ON g.sample_id = c.sample_id AND g.i = c.i
  LEFT JOIN (SELECT DISTINCT sample_id, ch FROM po) e ON g.sample_id = e.sample_id AND g.ch = e.ch
)"""
)
INF_MATCH = (
    OBS_MATCH
    + """, mapped AS (SELECT sample_id, gt_id, pred_id FROM om WHERE hit),
sets AS (
  SELECT c.sample_id, c.i, c.j, c.verdict, c.cost,
    list_distinct(CASE WHEN g.lost THEN ['O' || g.a, 'O' || g.b, 'O99'] ELSE ['O' || g.a, 'O' || g.b] END) AS gt_cited,
    list_distinct(CASE WHEN p.lost THEN ['O' || p.a, 'O' || p.b, 'O99'] ELSE ['O' || p.a, 'O' || p.b] END) AS pred_cited,
    coalesce((SELECT list(DISTINCT 'O' || num) FROM po WHERE po.sample_id = c.sample_id), []) AS existing,
    coalesce((SELECT list({'g': gt_id, 'p': pred_id}) FROM mapped m WHERE m.sample_id = c.sample_id), []) AS hits
  FROM chosen c JOIN gi g ON c.sample_id = g.sample_id AND c.i = g.i
  JOIN pi p ON c.sample_id = p.sample_id AND c.j = p.i WHERE c.kind = 'i'
), sets2 AS (
  SELECT *, list_distinct(list_transform(list_filter(hits, lambda h: list_contains(gt_cited, h.g)), lambda h: h.p)) AS mapped_gt,
    list_filter(pred_cited, lambda z: NOT list_contains(existing, z)) AS lost,
    list_filter(pred_cited, lambda z: list_contains(existing, z)) AS kept FROM sets
), jac AS (
  SELECT *, len(list_intersect(mapped_gt, pred_cited)) AS shared, len(list_distinct(list_concat(mapped_gt, pred_cited))) AS any_,
    len(list_intersect(mapped_gt, kept)) AS both_k, len(list_distinct(list_concat(mapped_gt, kept))) AS any_k FROM sets2
), im AS (
  SELECT sample_id, 'I' || i AS gt_id, 'I' || j AS pred_id, verdict AS judge_verdict, cost = 0 AS hit, cost / 2 AS cost,
    array_to_string(list_sort(gt_cited), ',') AS gt_based_on, array_to_string(list_sort(pred_cited), ',') AS pred_based_on,
    array_to_string(list_sort(mapped_gt), ',') AS mapped_gt_obs, array_to_string(list_sort(lost), ',') AS hallucinated_basis,
    len(lost) AS n_hallucinated_basis,
    CASE WHEN any_ > 0 THEN shared / any_ END AS iprov_abs,
    CASE WHEN len(lost) > 0 THEN 0.0 WHEN any_ > 0 THEN shared / any_ END AS iprov_clean,
    CASE WHEN any_k > 0 THEN greatest(-1.0, both_k / any_k - len(lost) / len(pred_cited)) END AS iprov_penalised
  FROM jac
)"""
)
SAMPLE_SCORES = (
    INF_MATCH
    + """, og AS (
  SELECT sample_id, sum(hit::INT) AS h, sum((hit AND temporal_match)::INT) AS ht,
    count(DISTINCT CASE WHEN hit THEN sensor END) AS covered, count(DISTINCT sensor) AS channels FROM om GROUP BY ALL
), ig AS (
  SELECT sample_id, sum(hit::INT) AS h, avg(iprov_abs) FILTER (hit) AS a, avg(iprov_clean) FILTER (hit) AS cl,
    avg(iprov_penalised) FILTER (hit) AS pe FROM im GROUP BY ALL
), raw_scores AS (
  SELECT r.sample_id, r.gt_activity, r.predicted_activity, skip_reason IS NOT NULL AS snm_skipped, skip_reason,
    CASE WHEN skip_reason IS NULL THEN n_gt END AS n_gt_obs, CASE WHEN skip_reason IS NULL THEN n_pred END AS n_pred_obs,
    CASE WHEN skip_reason IS NULL THEN m_gt END AS n_gt_inf, CASE WHEN skip_reason IS NULL THEN m_pred END AS n_pred_inf,
    CASE WHEN skip_reason IS NULL THEN coalesce(og.h, 0) END AS obs_hits,
    CASE WHEN skip_reason IS NULL THEN coalesce(ig.h, 0) END AS inf_hits,
    CASE WHEN skip_reason IS NULL THEN CASE WHEN gt_syn IS NULL OR pred_syn IS NULL THEN 'N/A' ELSE s.verdict END END AS synthesis_judge,
    og.ht, og.covered, og.channels, ig.a, ig.cl, ig.pe
  FROM reason r LEFT JOIN og USING (sample_id) LEFT JOIN ig USING (sample_id) LEFT JOIN syn_pair s USING (sample_id)
), s1 AS (
  SELECT *, obs_hits / n_pred_obs AS snm_op, obs_hits / n_gt_obs AS snm_or,
    CASE WHEN obs_hits > 0 THEN ht / obs_hits END AS snm_o_temporal, covered / channels AS snm_o_cover,
    CASE WHEN n_gt_inf > 0 AND n_pred_inf > 0 THEN inf_hits / n_pred_inf END AS snm_ip,
    CASE WHEN n_gt_inf > 0 AND n_pred_inf > 0 THEN inf_hits / n_gt_inf END AS snm_ir,
    a AS snm_iprov_abs, cl AS snm_iprov_clean, pe AS snm_iprov_penalised,
    CASE synthesis_judge WHEN 'YES' THEN 1.0 WHEN 'NO' THEN 0.0 END AS snm_sa
  FROM raw_scores
), s2 AS (
  SELECT *, n_gt_obs - obs_hits AS obs_misses, n_pred_obs - obs_hits AS obs_hallucinations,
    n_gt_inf - inf_hits AS inf_misses, n_pred_inf - inf_hits AS inf_hallucinations,
    CASE WHEN snm_op + snm_or = 0 THEN 0.0 ELSE 2 * snm_op * snm_or / (snm_op + snm_or) END AS snm_of1,
    CASE WHEN snm_ip + snm_ir = 0 THEN 0.0 ELSE 2 * snm_ip * snm_ir / (snm_ip + snm_ir) END AS snm_if1
  FROM s1
)"""
)
SCORE_NAMES = (
    "snm_op snm_or snm_of1 snm_o_temporal snm_o_cover snm_ip snm_ir snm_if1 snm_iprov_abs snm_iprov_clean "
    "snm_iprov_penalised snm_sa"
).split()
COUNT_NAMES = (
    "n_gt_obs n_pred_obs n_gt_inf n_pred_inf obs_hits obs_misses obs_hallucinations inf_hits inf_misses "
    "inf_hallucinations"
).split()


LEXICAL = (
    SAMPLE_SCORES.replace(
        "CASE WHEN g.q = p.q AND abs(g.w - p.w) <= 1 THEN 'YES' WHEN (7 * g.i + p.i + g.k) % 29 = 0 THEN 'ERROR'",
        "CASE WHEN g.q = p.q AND (g.w = p.w OR g.w = 5 OR p.w = 5 OR (g.w < 5 AND p.w < 5 AND abs(g.w - p.w) <= 1)) THEN 'YES'",
    )
    .replace("WHEN (g.i + 2 * p.i + g.k) % 31 = 0 THEN NULL ELSE", "ELSE")
    .replace(
        """CASE WHEN g.t = p.t AND (g.k + g.i + p.i) % 3 <> 0 THEN 'YES' WHEN (g.i + p.i + g.k) % 7 = 0 THEN 'ERROR'
      ELSE 'NO' END""",
        """CASE WHEN len(list_intersect(g.words, p.words)) / len(list_distinct(list_concat(g.words, p.words))) >= 0.5
      THEN 'YES' ELSE 'NO' END""",
    )
    .replace("CASE WHEN gt_syn_text = pred_syn_text THEN 'YES' WHEN k % 9 = 0 THEN 'ERROR' ELSE 'NO' END",
             "CASE WHEN gt_syn_text = pred_syn_text THEN 'YES' ELSE 'NO' END")
    .replace("gi AS (SELECT * FROM ref_inf", """ref_node AS (
  SELECT sample_id, num, SENSORS[arg_max(s, i) + 1] AS sensor FROM ref_obs GROUP BY ALL
), gi AS (SELECT r.*, WORDS AS words FROM ref_inf r LEFT JOIN ref_node o ON r.sample_id = o.sample_id AND r.a = o.num""")
    .replace("pi AS (SELECT * FROM gen_inf_base", """pi AS (
  SELECT r.*, WORDS AS words FROM gen_inf_base r LEFT JOIN gen_node o ON r.sample_id = o.sample_id AND r.a = o.num""")
    .replace("SEMI JOIN live USING (sample_id)),\npi", "WHERE r.sample_id IN (SELECT sample_id FROM live)),\npi")
    .replace("SEMI JOIN live USING (sample_id)),\ninf_pair", "WHERE r.sample_id IN (SELECT sample_id FROM live)),\ninf_pair")
    .replace("SENSORS[", f"{SENSORS_LOWER}[")
    .replace("WORDS AS", """list_distinct(list_filter(regexp_split_to_array(lower(CASE t
      WHEN 0 THEN 'the ' || coalesce(o.sensor, 'nothing') || ' signal moves'
      WHEN 1 THEN 'Motion in ' || replace(coalesce(o.sensor, 'nothing'), '_', ' ') || ' here'
      WHEN 2 THEN 'motion along z' ELSE 'calm and still' END), '[^a-z0-9_]+'), lambda u: u <> '')) AS""")
)


def _rounded(names, source="{}") -> str:
    return ", ".join(f"round(CAST({source.format(n)} AS DOUBLE), 6) AS {n}" for n in names)


def _integers(names) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def _report(source: str, labels: str) -> str:
    """Per-class report of a relation (gt, pred)."""
    return f"""lab AS (SELECT i - 1 AS ordinal, {labels}[i] AS label FROM unnest(range(1, len({labels}) + 1)) AS t(i)),
cls AS (
  SELECT ordinal, label, (SELECT count(*) FROM {source} WHERE gt = label AND pred = label) AS tp,
    (SELECT count(*) FROM {source} WHERE pred = label) AS pp, (SELECT count(*) FROM {source} WHERE gt = label) AS support
  FROM lab
), pr AS (
  SELECT *, CASE WHEN pp = 0 THEN 0.0 ELSE tp / pp END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall
  FROM cls
), rep AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr
)"""


_REP = f"SELECT CAST(ordinal AS BIGINT) AS ordinal, label, {_rounded(['precision', 'recall', 'f1'])}, support FROM rep"
_GUESS = "guess AS (SELECT gt_activity AS gt, predicted_activity AS pred FROM n)"
_LABELLED = "WITH guess AS (SELECT CAST(quality AS VARCHAR) AS gt, CAST(toxic AS VARCHAR) AS pred FROM labels), "


def _confusion(labels: str) -> str:
    return f"""SELECT g AS gt, p AS pred, count(guess.gt) AS n
FROM unnest({labels}) AS a(g) CROSS JOIN unnest({labels}) AS b(p)
LEFT JOIN guess ON guess.gt = g AND guess.pred = p GROUP BY ALL"""


def _flags(text: str) -> str:
    word = r"\p{L}\p{M}\p{N}_"
    leak = rf"(?:^|[^{word}])(?:\p{{Nd}}{{2,}}\.?\p{{Nd}}*|\p{{Nd}}+\.\p{{Nd}}+)(?:$|[^{word}])"
    refusal = (
        "(?i)i cannot|i can''t|as an ai|i am unable|i''m unable|i apologize|i''m sorry, but|sorry, i cannot"
        "|not able to (provide|generate|analyze)"
    )
    return f"""CAST(len(regexp_extract_all({text}, '{VISIBLE}+')) AS BIGINT) AS n_tokens,
      CAST(length({text}) AS BIGINT) AS n_chars, regexp_matches({text}, '{leak}') AS leak,
      NOT regexp_matches({text}, '{VISIBLE}') AS is_empty, regexp_matches({text}, '{refusal}') AS refusal"""


_FLAGGED = """*, n_tokens < 50 AS is_short, n_tokens >= 1024 AS truncated,
  leak OR is_empty OR n_tokens < 50 OR refusal AS anomaly"""


def _term_recall(ref: str, gen: str, terms: str) -> str:
    return f"""(SELECT CASE WHEN count(*) > 0 THEN count(*) FILTER (contains(lower({gen}), t)) / count(*) END
      FROM unnest({terms}) AS u(t) WHERE contains(lower({ref}), t))"""


WORDS = _list(["the", "and", "tion", "der", "une", "ing ", "zzz"])
RUN_LOG = """WITH log AS (
  SELECT event_type AS dataset, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seq,
    floor(value) AS tokens, floor(value) * 5 + user_id % 5 AS chars, (user_id % 4 = 0)::INT AS leak,
    (user_id % 9 = 0)::INT AS refusal, (event_id % 6 = 0)::INT AS parse_fail, event_id % 10 AS n_obs,
    user_id % 4 AS n_inf, (user_id % 7 + 1) / 10.0::DOUBLE AS seconds FROM events
), logb AS (SELECT *, seq // 128 AS batch FROM log)"""
_ROLLING = {
    "avg_tokens": "tokens", "avg_chars": "chars", "leak_rate": "leak", "refusal_rate": "refusal",
    "parse_fail_rate": "parse_fail", "avg_observations": "n_obs", "avg_inferences": "n_inf",
}
RUNS = f"""{RELATION.strip()}, guess AS (
  SELECT run, gt_activity AS gt, CASE WHEN (k + c) % 11 = 0 THEN 'off the list'
    ELSE {CLASSES}[(p % 6 + CASE WHEN (c + run * k) % 4 = 0 THEN 1 ELSE 0 END) % 6 + 1] END AS pred
  FROM n, unnest([1, 2, 3]) AS t(run)
), lab AS (SELECT unnest({CLASSES}) AS label, unnest([1, 2, 3]) AS dummy),
cls AS (
  SELECT run, label, count(*) FILTER (gt = label AND pred = label) AS tp, count(*) FILTER (pred = label) AS pp,
    count(*) FILTER (gt = label) AS support
  FROM guess, (SELECT unnest({CLASSES}) AS label) GROUP BY ALL
), pr AS (
  SELECT *, CASE WHEN pp = 0 THEN 0.0 ELSE tp / pp END AS pre, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rec FROM cls
), mac AS (
  SELECT run, avg(pre) AS macro_precision, avg(rec) AS macro_recall,
    avg(CASE WHEN pre + rec = 0 THEN 0.0 ELSE 2 * pre * rec / (pre + rec) END) AS macro_f1 FROM pr GROUP BY ALL
), ovr AS (SELECT run, count(*) AS n, avg((gt = pred)::INT) AS accuracy FROM guess GROUP BY ALL),
long AS (
  SELECT run, 'n' AS metric, CAST(n AS DOUBLE) AS value, true AS is_count FROM ovr
  UNION ALL SELECT run, 'accuracy', accuracy, false FROM ovr
  UNION ALL SELECT run, 'macro_precision', macro_precision, false FROM mac
  UNION ALL SELECT run, 'macro_recall', macro_recall, false FROM mac
  UNION ALL SELECT run, 'macro_f1', macro_f1, false FROM mac
)"""


def _prompt() -> str:
    """The prompt as SQL: the template text with its nine values put in one after the other."""
    values = [
        "sample_id", "activity", "printf('%.4f', confidence)", "printf('%.4f', threshold)", "lines", "phases",
        "CAST(n_obs AS VARCHAR)", "'" + ", ".join(sorted(UCIHAR_SENSORS)) + "'", "activity",
    ]
    pieces = PROMPT.replace("%.4f", "%s").replace("%d", "%s").split("%s")
    quoted = ["'" + piece.replace("'", "''") + "'" for piece in pieces]
    out = quoted[0]
    for value, piece in zip(values, quoted[1:], strict=True):
        out += f" || {value} || {piece}"
    return out


def _values(rows) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b, _, _ in rows)


def _rates(classes: str) -> str:
    return f"""        round(sum(ok::INT) / count(*), 6) AS obs_parse_rate, round(sum(ok_sensor) / sum(obs), 6) AS obs_sensor_valid_rate,
        CAST(1.0 AS DOUBLE) AS obs_temporal_rate, round(sum(ok_conf) / sum(obs), 6) AS obs_confidence_rate,
        round(sum((ok AND inf > 0)::INT) / sum(ok::INT), 6) AS obs_coverage_rate,
        round(sum((ok AND inf > 0)::INT) / sum(ok::INT), 6) AS inf_present_rate,
        round(sum(CASE WHEN ok THEN st END) / sum(CASE WHEN ok THEN inf END), 6) AS inf_structural_rate,
        round(sum(CASE WHEN ok THEN sem END) / sum(CASE WHEN ok THEN inf END), 6) AS inf_semantic_rate,
        round(sum(CASE WHEN ok AND inf > 0 THEN cited END) / sum(CASE WHEN ok AND inf > 0 THEN ids END), 6) AS inf_obs_coverage,
        round(sum((ok AND pred_syn IS NOT NULL)::INT) / sum(ok::INT), 6) AS syn_present_rate,
        round(sum((ok AND pred_syn IS NOT NULL AND pred_syn <= m_pred)::INT) / sum((ok AND pred_syn IS NOT NULL)::INT), 6) AS syn_ref_rate,
        round(sum(coalesce(list_contains({classes}, gen_activity), false)::INT) / count(*), 6) AS syn_activity_valid_rate,
        count(*) AS n_total, CAST(sum(ok::INT) AS BIGINT) AS n_parsed"""


def _dataset(k: str) -> str:
    return f"CASE WHEN {k} % 3 = 0 THEN 'PAMAP2' WHEN {k} % 7 = 1 THEN 'elsewhere' ELSE 'ucihar' END"


def _by_dataset(kind: str, k: str | None = None, order=list) -> str:
    """The list of a row's dataset: by its column, or computed from the order's key."""
    name = "dataset" if k is None else _dataset(k)
    lists = [f"WHEN '{n}' THEN {_list(order(getattr(registry.lookup(n), kind)))}" for n in ("ucihar", "PAMAP2", "elsewhere")]
    return f"CASE {name} {' '.join(lists)} END"


def _longest(classes) -> list[str]:
    return sorted(classes, key=lambda c: -len(c))


_RECALL = """
ref_terms AS (SELECT DISTINCT sample_id, s FROM ref_obs WHERE s < 4),
        gen_terms AS (SELECT DISTINCT sample_id, s FROM gen_obs WHERE s < 4),
        recall AS (
          SELECT n.sample_id, n.gt_activity, n.predicted_activity,
            CASE WHEN count(r.s) > 0 THEN count(g.s) / count(r.s) END AS r
          FROM n LEFT JOIN ref_terms r USING (sample_id)
          LEFT JOIN gen_terms g ON g.sample_id = n.sample_id AND g.s = r.s WHERE has_ref GROUP BY ALL
        )"""


def _question(kind: str, relaxed: bool) -> str:
    return ("\n" + matching._QUESTIONS[kind, relaxed] + matching._ANSWER_FORM).replace("'", "''").replace("\n", "' || chr(10) || '")


def _asked(relaxed: bool) -> str:
    """All pairs with the text of their request, from the relation."""
    side = lambda name, w, q: f"'{name}" + (": ' ||" if relaxed else f" (' || {WINDOWS}[{w} + 1] || '): ' ||") + f" {PATTERNS}[{q} + 1]"
    far = "CASE WHEN d > 1 THEN 'NO' END" if relaxed else "NULL"
    text = f"'Sensor: ' || grp || chr(10) || {side('Reference', 'gw', 'gq')} || chr(10) || {side('Generated', 'pw', 'pq')} || '{_question('observation', relaxed)}'"
    return f"""
ref_node AS (SELECT sample_id, num, {SENSORS_LOWER}[arg_max(s, i) + 1] AS sensor FROM ref_obs GROUP BY ALL),
ref_txt AS (
  SELECT x.*, CASE t WHEN 0 THEN 'the ' || coalesce(o.sensor, 'nothing') || ' signal moves'
      WHEN 1 THEN 'Motion in ' || replace(coalesce(o.sensor, 'nothing'), '_', ' ') || ' here'
      WHEN 2 THEN 'motion along z' ELSE 'calm and still' END AS text
  FROM ref_inf x LEFT JOIN ref_node o ON x.sample_id = o.sample_id AND x.a = o.num
), seen AS (
  SELECT x.*, g.q AS gq, p.q AS pq, CASE WHEN gw = pw OR gw = 5 OR pw = 5 THEN 0 WHEN gw = 6 OR pw = 6 THEN 999
    ELSE abs(gw - pw) END AS d
  FROM obs_pair x JOIN ref_obs g ON g.sample_id = x.sample_id AND g.i = x.i JOIN gen_obs p ON p.sample_id = x.sample_id AND p.i = x.j
), asked AS (
  SELECT sample_id, 'observation' AS kind, i - 1 AS i, j - 1 AS j, CASE WHEN {far} IS NULL THEN {text} END AS request, {far} AS auto_verdict
  FROM seen
  UNION ALL SELECT x.sample_id, 'inference', x.i - 1, x.j - 1,
    'Reference: ' || g.text || chr(10) || 'Generated: ' || p.text || '{_question('inference', relaxed)}', NULL
  FROM inf_pair x JOIN ref_txt g ON g.sample_id = x.sample_id AND g.i = x.i JOIN gen_inf p ON p.sample_id = x.sample_id AND p.i = x.j
  UNION ALL SELECT sample_id, 'synthesis', 0, 0,
    'Reference: ' || {SYNTHESES}[gt_syn_text + 1] || chr(10) || 'Generated: ' || {SYNTHESES}[pred_syn_text + 1] || '{_question('synthesis', relaxed)}', NULL
  FROM syn_pair JOIN live USING (sample_id)
)"""


_CALLS = """, each AS (
  SELECT sha256(kind || chr(10) || request) AS request_id, kind, request, count(*) AS n_pairs
  FROM asked WHERE request IS NOT NULL GROUP BY ALL
), first AS (SELECT request_id FROM (SELECT request_id, (row_number() OVER (ORDER BY request_id) - 1) // 64 AS b FROM each) WHERE b % 2 = 0)"""


_NAMED = f"""
named AS (
  SELECT s2.* EXCLUDE (predicted_activity), {_dataset('CAST(s2.sample_id AS BIGINT)')} AS dataset,
    coalesce(list_filter({_by_dataset('classes', 'CAST(s2.sample_id AS BIGINT)', _longest)}, lambda c: contains(n.gen_activity, c))[1],
      n.gen_activity, 'unknown') AS predicted_activity
  FROM s2 JOIN n USING (sample_id)
)"""


ORACLES = {
    "trace_observations": _on_relation(_node("reference", "ref_obs") + " UNION ALL " + _node("generated", "gen_obs")),
    "trace_inferences": _on_relation(
        """SELECT sample_id, i - 1 AS pos, 'I' || i AS id,
        'O' || a || ',O' || b || CASE WHEN lost THEN ',O99' ELSE '' END AS based_on, text AS inference,
        'high' AS confidence FROM gen_inf"""
    ),
    "trace_citations": _on_relation(
        """SELECT x.sample_id, 'inference' AS layer, 'I' || x.i AS node_id, CAST(x.pos AS BIGINT) AS pos,
          'O' || x.cited AS cited_id, o.num IS NOT NULL AS resolved
        FROM gen_cite x LEFT JOIN gen_node o ON x.sample_id = o.sample_id AND x.cited = o.num
        UNION ALL SELECT sample_id, 'synthesis', 'S', 0, 'I' || pred_syn, pred_syn <= m_pred
        FROM n WHERE has_gen AND pred_syn IS NOT NULL"""
    ),
    "trace_conclusions": _on_relation(
        f"""SELECT sample_id, CASE WHEN has_gen THEN 'I' || pred_syn END AS synthesis_cites,
        CASE WHEN has_gen AND pred_syn IS NOT NULL THEN {SYNTHESES}[pred_syn_text + 1] END AS synthesis,
        gen_activity AS activity, CAST(gen_n AS BIGINT) AS n_observations, CAST(gen_m AS BIGINT) AS n_inferences,
        gen_n = 0 AS parse_failed FROM sized"""
    ),
    "parse_success": _on_relation(
        """SELECT gt_activity, count(*) AS n, round(avg((gen_n > 0)::INT), 6) AS psr,
        round(avg((ref_n > 0)::INT), 6) AS ref_psr FROM sized WHERE has_ref GROUP BY ALL"""
    ),
    "node_rates_by_class": _on_relation(f"SELECT gt_activity, {_rates(CLASSES)} FROM counts GROUP BY ALL", NODES),
    "dataset_node_rates": _on_relation(
        f"SELECT dataset, {_rates(_by_dataset('classes'))} FROM tagged GROUP BY ALL",
        NODES.replace("s IN (0, 1, 2)", f"list_contains({_by_dataset('sensors', 'k')}, {SENSORS_LOWER}[s + 1])")
        + f", tagged AS (SELECT *, {_dataset('k')} AS dataset FROM counts)",
    ),
    "chain_validity_samples": _on_relation(
        """SELECT sample_id, round(s, 6) AS rcv_structural, round(m, 6) AS rcv_semantic,
        round(m, 6) AS rcv_combined FROM chain""", CHAIN,
    ),
    "chain_validity": _on_relation(
        """SELECT gt_activity, round(avg(s), 6) AS rcv_structural, round(avg(m), 6) AS rcv_semantic,
        round(avg(m), 6) AS rcv_combined FROM chain GROUP BY ALL""", CHAIN,
    ),
    "coverage_by_class": _on_relation(
        """SELECT gt_activity AS activity, round(avg(gc), 6) AS gc_mean, round(any_value(mean), 6) AS ref_obs_mean,
        count(*) AS n_scored FROM gc GROUP BY ALL""", COVERAGE,
    ),
    "coverage": _on_relation("SELECT round(avg(gc), 6) AS gc_mean FROM gc", COVERAGE),
    "grounding_samples": _on_relation(
        f"SELECT sample_id, parse_failed, {_rounded(['gs_precision', 'gs_recall', 'gs_f1'])} FROM gsf", GROUNDING
    ),
    "grounding": _on_relation(
        """SELECT round(avg(gs_recall), 6) AS gs_recall, round(avg(gs_precision), 6) AS gs_precision,
        round(avg(gs_f1), 6) AS gs_f1, count(gs_f1) AS n_scored,
        count(*) FILTER (gs_f1 IS NULL AND NOT parse_failed) AS n_skipped,
        count(*) FILTER (parse_failed) AS n_parse_fail FROM gsf""", GROUNDING,
    ),
    "predicted_activities": _on_relation("SELECT sample_id, gt_activity, predicted_activity FROM n"),
    "classification_summary": _on_relation(
        f"""SELECT (SELECT count(*) FROM guess) AS n,
        (SELECT round(avg((gt = pred)::INT), 6) FROM guess) AS accuracy, round(avg(precision), 6) AS macro_precision,
        round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM rep WHERE label <> 'unknown'""",
        _GUESS + ", " + _report("guess", LABELS),
    ),
    "class_report": _on_relation(_REP, _GUESS + ", " + _report("guess", LABELS)),
    "confusion_matrix": _on_relation(_confusion(LABELS), _GUESS),
    "label_report": _LABELLED + _report("guess", "['0', '1', '2']") + _REP,
    "label_confusion": _LABELLED.rstrip(", ") + """ SELECT g AS gt, count(guess.gt) FILTER (pred = '0') AS pred_0,
        count(guess.gt) FILTER (pred = '1') AS pred_1, count(guess.gt) FILTER (pred = '2') AS pred_2
        FROM unnest(['0', '1', '2']) AS a(g) LEFT JOIN guess ON guess.gt = g GROUP BY ALL""",
    "turn_rouge_l": """WITH pairs AS (
          SELECT a.conv_id, a.turn, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS r,
            regexp_extract_all(lower(b.text), '[a-z0-9]+') AS g
          FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
        ), lcs AS (
          SELECT *, coalesce(list_last(list_reduce(g, lambda line, word:
            list_reduce(range(1, len(r) + 1), lambda acc, x: list_append(acc,
              CASE WHEN r[x] = word THEN line[x] + 1 ELSE greatest(acc[x], line[x + 1]) END), [0::BIGINT]),
            list_transform(range(0, len(r) + 1), lambda z: 0::BIGINT))), 0) AS common FROM pairs
        ), pr AS (
          SELECT *, CASE WHEN len(g) = 0 THEN 0.0 ELSE common / len(g) END AS p,
            CASE WHEN len(r) = 0 THEN 0.0 ELSE common / len(r) END AS q FROM lcs)
        SELECT conv_id, turn, round(CASE WHEN p + q = 0 THEN 0.0 ELSE 2 * p * q / (p + q) END, 6) AS rouge_l FROM pr""",
    "document_term_recall": f"""SELECT a.doc_id, round({_term_recall('a.text', 'b.text', WORDS)}, 6) AS sensor_term_recall
        FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND a.lang = b.lang""",
    "conditioned_term_recall": _on_relation(
        """SELECT condition, count(*) AS n, round(avg(r), 6) AS sensor_term_recall
        FROM recall, unnest(['all', CASE WHEN gt_activity = predicted_activity THEN 'correct' ELSE 'incorrect' END]) AS t(condition)
        GROUP BY ALL""",
        _RECALL,
    ),
    "condition_counts": _on_relation(
        """SELECT count(*) AS n_total_cls, count(*) FILTER (has_ref) AS n_total_text_gt,
        count(*) FILTER (gt_activity = predicted_activity) AS n_correct_activity,
        count(*) FILTER (gt_activity <> predicted_activity) AS n_incorrect_activity,
        count(*) FILTER (gt_activity = predicted_activity AND has_ref) AS n_correct_activity_gt,
        count(*) FILTER (gt_activity <> predicted_activity AND has_ref) AS n_incorrect_activity_gt FROM n"""
    ),
    "vector_f1": """WITH v AS (
          SELECT vec_id // 8 AS sample_id, vec_id % 2 = 0 AS ref, (vec_id % 8) // 2 AS pos, CAST(embedding AS DOUBLE[]) AS e
          FROM embeddings
        ), s AS (
          SELECT a.sample_id, a.pos AS ap, b.pos AS bp, list_cosine_similarity(a.e, b.e) AS cs
          FROM v a JOIN v b ON a.sample_id = b.sample_id AND a.ref AND NOT b.ref
        ), r AS (SELECT sample_id, avg(m) AS x FROM (SELECT sample_id, ap, max(cs) AS m FROM s GROUP BY ALL) GROUP BY ALL),
        p AS (SELECT sample_id, avg(m) AS x FROM (SELECT sample_id, bp, max(cs) AS m FROM s GROUP BY ALL) GROUP BY ALL)
        SELECT sample_id, round(p.x, 6) AS vector_precision, round(r.x, 6) AS vector_recall,
          round(2 * p.x * r.x / (p.x + r.x), 6) AS vector_f1
        FROM (SELECT DISTINCT sample_id FROM v) LEFT JOIN p USING (sample_id) LEFT JOIN r USING (sample_id)""",
    "judge_requests": _on_relation(
        """SELECT sample_id, 'observation' AS kind, i - 1 AS i, j - 1 AS j, d <= 1 AS asked,
          CASE WHEN d > 1 THEN 'NO' END AS auto_verdict
        FROM (SELECT *, CASE WHEN gw = pw OR gw = 5 OR pw = 5 THEN 0 WHEN gw = 6 OR pw = 6 THEN 999
          ELSE abs(gw - pw) END AS d FROM obs_pair)
        UNION ALL SELECT sample_id, 'inference', i - 1, j - 1, true, NULL FROM inf_pair
        UNION ALL SELECT sample_id, 'synthesis', 0, 0, true, NULL FROM syn_pair""", MATCH,
    ),
    "parsed_verdicts": "WITH RECURSIVE "
    + (RELATION.strip() + ", " + MATCH.strip()).replace("c % 19 NOT IN (0, 1) AS has_ref", "true AS has_ref")
    .replace("c % 23 <> 0 AND NOT", "true OR NOT")
    .replace("live AS (SELECT * FROM reason WHERE skip_reason IS NULL)", "live AS (SELECT * FROM reason)")
    + """SELECT sample_id, 'observation' AS kind, i - 1 AS i, j - 1 AS j, verdict FROM obs_pair WHERE verdict IS NOT NULL
    UNION ALL SELECT sample_id, 'inference', i - 1, j - 1, verdict FROM inf_pair
    UNION ALL SELECT sample_id, 'synthesis', 0, 0, verdict FROM syn_pair""",
    "unresolved_sensors": _on_relation(
        """SELECT 'heart_rate' AS raw, count(*) AS n FROM (
          SELECT o.s FROM ref_obs o JOIN n USING (sample_id) WHERE has_gen
          UNION ALL SELECT o.s FROM gen_obs o JOIN n USING (sample_id) WHERE has_ref) WHERE s = 4 HAVING count(*) > 0"""
    ),
    "observation_matches": _on_relation(
        """SELECT sample_id, gt_id, pred_id, sensor, temporal_match, judge_verdict, hit, CAST(cost AS DOUBLE) AS cost
        FROM om""", OBS_MATCH,
    ),
    "inference_matches": _on_relation(
        f"""SELECT sample_id, gt_id, pred_id, judge_verdict, hit, CAST(cost AS DOUBLE) AS cost, gt_based_on, pred_based_on,
        mapped_gt_obs, hallucinated_basis, CAST(n_hallucinated_basis AS BIGINT) AS n_hallucinated_basis,
        {_rounded(['iprov_abs', 'iprov_clean', 'iprov_penalised'])} FROM im""", INF_MATCH,
    ),
    "match_scores": _on_relation(
        f"""SELECT sample_id, gt_activity, predicted_activity, snm_skipped, skip_reason, synthesis_judge,
        {_integers(COUNT_NAMES)}, {_rounded(SCORE_NAMES)} FROM s2""", SAMPLE_SCORES,
    ),
    "match_summary": _on_relation(
        f"""SELECT stratum, count(*) AS n_total, count(*) FILTER (NOT snm_skipped) AS n_scored,
        count(*) FILTER (snm_skipped) AS n_skipped, count(*) FILTER (skip_reason = 'gt_parse_fail') AS n_gt_parse_fail,
        count(*) FILTER (skip_reason = 'pred_parse_fail') AS n_pred_parse_fail, {_rounded(SCORE_NAMES, 'avg({})')}
        FROM s2, unnest(CASE WHEN snm_skipped THEN ['all'] WHEN gt_activity = predicted_activity THEN ['all', 'correct']
          ELSE ['all', 'incorrect'] END) AS t(stratum) GROUP BY ALL""", SAMPLE_SCORES,
    ),
    "lexical_match_summary": _on_relation(
        f"""SELECT stratum, count(*) AS n_total, count(*) FILTER (NOT snm_skipped) AS n_scored,
        count(*) FILTER (snm_skipped) AS n_skipped, count(*) FILTER (skip_reason = 'gt_parse_fail') AS n_gt_parse_fail,
        count(*) FILTER (skip_reason = 'pred_parse_fail') AS n_pred_parse_fail, {_rounded(SCORE_NAMES, 'avg({})')}
        FROM s2, unnest(CASE WHEN snm_skipped THEN ['all'] WHEN gt_activity = predicted_activity THEN ['all', 'correct']
          ELSE ['all', 'incorrect'] END) AS t(stratum) GROUP BY ALL""", LEXICAL,
    ),
    "file_identities": _on_relation(
        "SELECT file_name, split, file_id AS sample_id, has_id FROM docs", ATTRIBUTIONS
    ),
    "ranked_evidence": _on_relation(
        f"""SELECT file_name, CAST(r AS BIGINT) AS rank, raw AS raw_sensor, sensor,
        {_integers(['start_t', 'end_t', 'length'])}, {_rounded(['mean_importance', 'max_importance'])},
        CAST(peak_timestep AS BIGINT) AS peak_timestep, "window", tier FROM evidence""", ATTRIBUTIONS,
    ),
    "prompt_texts": _on_relation(
        f"""SELECT file_name, md5(t) AS prompt_md5, CAST(length(t) AS BIGINT) AS n_chars FROM (SELECT file_name, {_prompt()} AS t FROM doc)""",
        ATTRIBUTIONS
        + """, line AS (
          SELECT file_name, string_agg(printf('%d. %s (raw name %s), steps %d to %d, length %d: mean %s, max %.4f, peak at %d, window %s, tier %s',
            r, sensor, raw, start_t, end_t, length, coalesce(printf('%.4f', mean_importance), 'null'), max_importance, peak_timestep, "window", tier),
            chr(10) ORDER BY r) AS lines, count(*) AS n_obs FROM evidence GROUP BY ALL
        ), doc AS (
          SELECT d.file_name, d.sample_id, gt_activity AS activity, p % 100 / 100.0::DOUBLE AS confidence,
            CASE WHEN k % 4 <> 0 THEN c % 10 / 100.0::DOUBLE ELSE 0.0 END AS threshold,
            coalesce(lines, '(No region lies above the threshold.)') AS lines, coalesce(n_obs, 0) AS n_obs,
            printf('Phase start: %.4f', p % 7 / 10.0::DOUBLE) || chr(10) || printf('Phase end: %.4f', p % 9 / 10.0::DOUBLE) AS phases
          FROM docs d LEFT JOIN line USING (file_name)
        )""",
    ),
    "document_flags": f"""SELECT {_FLAGGED} FROM (SELECT doc_id, {_flags('t')} FROM (
        SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'I Cannot say. ' || text ELSE text END AS t FROM documents))""",
    "turn_flags": f"""SELECT {_FLAGGED} FROM (SELECT conv_id, turn, role, {_flags('text')} FROM conversations)""",
    "class_quality": f"""SELECT lang AS activity, round(avg(n_tokens), 6) AS avg_output_tokens,
        round(avg(confidence), 6) AS avg_confidence, round(avg(anomaly::INT), 6) AS anomaly_rate, count(*) AS sample_count
        FROM (SELECT {_FLAGGED} FROM (SELECT lang, CAST(nc % 100 AS DOUBLE) / 100 AS confidence, {_flags('text')}
          FROM (SELECT lang, documents.n_chars AS nc, text FROM documents))) GROUP BY ALL""",
    "oversized_prompts": f"""SELECT lang AS split, CAST(doc_id AS VARCHAR) AS sample_id,
        CAST(len(regexp_extract_all(text, '{VISIBLE}+')) AS BIGINT) AS prompt_tokens FROM documents
        WHERE len(regexp_extract_all(text, '{VISIBLE}+')) > 1000""",
    "training_examples": f"""SELECT source AS split, CAST(doc_id AS VARCHAR) AS sample_id,
        'Activity Recognition Task:' || chr(10) || 'Analyze the following sensor data and predict the activity.' || chr(10) || chr(10)
          || 'Sample ID: ' || doc_id || chr(10) || 'Model Confidence: ' || printf('%.4f', n_chars % 100 / 100.0::DOUBLE) || chr(10) AS input,
        md5('Conclusion:' || chr(10) || trim(text, {BLANK_CHARS}) || chr(10) || chr(10) || 'Predicted Activity: ' || lang || chr(10)) AS output_md5,
        true AS parse_failed FROM documents""",
    "smallest_sources": """SELECT source || '_s' || doc_id AS file_name, n_chars AS file_size FROM documents
        ORDER BY n_chars, source || '_s' || doc_id LIMIT 40""",
    "merged_shards": """SELECT event_id AS index, event_type, round(value, 6) AS value FROM events""",
    "frequent_unresolved_sensors": _on_relation(
        f"""SELECT {SENSORS_LOWER}[s + 1] AS raw, count(*) AS n FROM (
          SELECT o.s FROM ref_obs o JOIN n USING (sample_id) WHERE has_gen
          UNION ALL SELECT o.s FROM gen_obs o JOIN n USING (sample_id) WHERE has_ref) WHERE s <> 4
        GROUP BY ALL ORDER BY n DESC, raw LIMIT 3"""
    ),
    "remaining_sources": _on_relation(
        "SELECT split, file_id AS sample_id FROM docs WHERE has_id AND p % 100 >= 50", ATTRIBUTIONS
    ),
    "source_counts": _on_relation(
        """SELECT split, count(*) AS n_sources, count(*) FILTER (p % 100 < 50) AS n_processed,
        count(*) FILTER (p % 100 >= 50) AS n_remaining FROM docs WHERE has_id GROUP BY ALL""", ATTRIBUTIONS,
    ),
    "new_corpus_rows": """SELECT split, sample_id, event_id, round(value, 6) AS value FROM (
          SELECT event_type AS split, CAST(user_id AS VARCHAR) AS sample_id, event_id, value,
            row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS place,
            bool_or(value > 150) OVER (PARTITION BY event_type, user_id) AS known FROM events)
        WHERE place = 1 AND NOT known""",
    "train_validation_split": """SELECT doc_id, lang, CASE WHEN place <= round(0.2 * n) THEN 'validation' ELSE 'train' END AS fold
        FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n,
          row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 7919) % 10007, doc_id) AS place FROM documents)""",
    "latest_references": """SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, coalesce(t.text, '') AS ground_truth_reasoning
        FROM documents d LEFT JOIN (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE text <> '' GROUP BY ALL) t
        ON d.doc_id = t.conv_id""",
    "attribution_index": _on_relation(
        """SELECT l.sample_id, (SELECT count(*) FROM regions g WHERE g.k = l.k AND g.file_name = l.file_name) AS n_regions,
        coalesce((SELECT string_agg(sensor, ',' ORDER BY sensor) FROM important i WHERE i.sample_id = l.sample_id), '') AS important
        FROM latest l""", ATTRIBUTIONS,
    ),
    "rolling_quality": RUN_LOG + ", rolled AS (SELECT dataset, batch, seq, "
    + ", ".join(f"avg({c}) OVER w AS {n}" for n, c in _ROLLING.items())
    + """, max(seq) OVER (PARTITION BY dataset, batch) AS last FROM logb
        WINDOW w AS (PARTITION BY dataset ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
        SELECT dataset, batch, seq, """ + _rounded(_ROLLING) + " FROM rolled WHERE seq = last",
    "run_throughput": RUN_LOG + """, b AS (
          SELECT dataset, batch, count(*) AS n, sum(tokens) AS tokens, sum(seconds) AS seconds FROM logb GROUP BY ALL
        ), w AS (
          SELECT *, sum(n) OVER (PARTITION BY dataset ORDER BY batch) AS n_done, sum(n) OVER (PARTITION BY dataset) AS n_total,
            avg(seconds) OVER (PARTITION BY dataset ORDER BY batch ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean_latency FROM b)
        SELECT dataset, batch, CAST(n_done AS BIGINT) AS n_done, round(tokens / seconds, 6) AS tokens_per_sec,
          round(n * 3600 / seconds, 6) AS samples_per_hour, round(n_done * 100 / n_total, 6) AS pct_complete,
          round(mean_latency, 6) AS mean_latency, round((n_total - n_done) / 128 * mean_latency / 60, 6) AS eta_minutes FROM w""",
    "every_50th": """SELECT event_id, event_type, pos FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos,
        count(*) OVER () AS n FROM events) WHERE pos % 50 = 0 OR pos = n - 1""",
    "qualitative_samples": """SELECT doc_id, lang, substring(text, 1, 500) AS snippet FROM (
          SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
        WHERE (pos // 4) % 50 = 0 AND pos % 4 < 2""",
    "window_distances": """SELECT k, CAST(CASE WHEN a = b OR a = 5 OR b = 5 THEN 0 WHEN a > 4 OR b > 4 THEN 999 ELSE abs(a - b) END AS BIGINT) AS distance
        FROM (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) % 8 AS a,
          (CAST(round(o_totalprice * 100) AS BIGINT) + o_custkey) % 8 AS b FROM orders)""",
    "registry_sizes": f"""WITH named AS (
          SELECT ['ucihar', 'pamap2', 'uschad', 'capture24', 'opportunity', 'shoaib', 'mhealth'][CAST(round(o_totalprice * 100) AS BIGINT) % 7 + 1] AS dataset,
            count(*) AS n_orders FROM orders GROUP BY ALL)
        SELECT dataset, n_orders, kind, count(*) AS n_values FROM named JOIN (VALUES {_values(dimension_rows())}) AS r(dataset, kind)
        USING (dataset) GROUP BY ALL""",
    "run_statistics": f"""WITH {RUNS} SELECT metric, round(avg(value) FILTER (NOT is_count), 6) AS mean,
        round(coalesce(stddev_samp(value) FILTER (NOT is_count), 0.0), 6) AS std, count(*) AS n_runs FROM long GROUP BY ALL""",
    "combined_report": f"""WITH {RUNS}, shown AS (SELECT *, CASE WHEN is_count THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
          ELSE printf('%.4f', value) END AS s FROM long)
        SELECT metric, max(s) FILTER (run = 1) AS run_1, max(s) FILTER (run = 2) AS run_2, max(s) FILTER (run = 3) AS run_3,
          coalesce(printf('%.4f', avg(value) FILTER (NOT is_count)), 'N/A') AS mean,
          printf('%.4f', coalesce(stddev_samp(value) FILTER (NOT is_count), 0.0)) AS std FROM shown GROUP BY ALL""",
    "evaluation_file_report": f"""SELECT file, CASE file % 4 WHEN 0 THEN 'array' WHEN 1 THEN 'object' END AS shape,
          CASE file % 4 WHEN 2 THEN 'neither an array of rows nor an object with them' WHEN 3 THEN 'not JSON' END AS reason,
          CASE WHEN file % 4 IN (1, 2) THEN file END AS run, CASE WHEN file % 4 IN (1, 2) THEN 3 END AS n_runs,
          CASE WHEN file % 4 IN (1, 2) THEN 'm' || file END AS model,
          CASE WHEN file % 4 < 2 THEN n ELSE 0 END AS n_rows, CASE WHEN file % 8 = 0 THEN 1 ELSE 0 END AS n_bad
        FROM (SELECT doc_id // {derived.FILE_ROWS} AS file, count(*) AS n FROM documents GROUP BY ALL)""",
    "evaluation_file_rows": f"""SELECT 'ucihar' AS dataset, file, pos, coalesce(CASE WHEN doc_id % 5 <> 0 THEN doc_id END, pos)::VARCHAR AS sample_id,
          lang AS gt_activity, source AS predicted_activity, md5(text) AS text_md5, doc_id % 2 = 0 AS prefix_active
        FROM (SELECT *, doc_id // {derived.FILE_ROWS} AS file,
              row_number() OVER (PARTITION BY doc_id // {derived.FILE_ROWS} ORDER BY doc_id) - 1 AS pos FROM documents)
        WHERE file % 4 < 2""",
    "dataset_match_summary": _on_relation(
        f"""SELECT dataset, stratum, count(x.sample_id) AS n_total, count(x.sample_id) FILTER (NOT snm_skipped) AS n_scored,
        count(x.sample_id) FILTER (snm_skipped) AS n_skipped, count(x.sample_id) FILTER (skip_reason = 'gt_parse_fail') AS n_gt_parse_fail,
        count(x.sample_id) FILTER (skip_reason = 'pred_parse_fail') AS n_pred_parse_fail, {_rounded(SCORE_NAMES, 'avg({})')}
        FROM (SELECT DISTINCT dataset FROM named) CROSS JOIN unnest(['all', 'correct', 'incorrect']) AS t(stratum)
        LEFT JOIN (SELECT *, CASE WHEN snm_skipped THEN ['all'] WHEN gt_activity = predicted_activity THEN ['all', 'correct']
          ELSE ['all', 'incorrect'] END AS strata FROM named) x USING (dataset)
        WHERE list_contains(strata, stratum) GROUP BY ALL""", SAMPLE_SCORES + ", " + _NAMED.strip(),
    ),
    "dataset_unresolved_sensors": _on_relation(
        f"""SELECT dataset, {SENSORS_LOWER}[s + 1] AS raw, count(*) AS n FROM (
          SELECT {_dataset('k')} AS dataset, s FROM (
            SELECT o.k, o.s FROM ref_obs o JOIN n USING (sample_id) WHERE has_gen
            UNION ALL SELECT o.k, o.s FROM gen_obs o JOIN n USING (sample_id) WHERE has_ref))
        WHERE NOT list_contains({_by_dataset('sensors')}, {CANONICAL}[s + 1]) GROUP BY ALL"""
    ),
    "ingested_corpus": f"""SELECT lang AS split, CAST(doc_id // 4 AS VARCHAR) AS sample_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS file_name,
          n_tokens, leak, is_short
        FROM (SELECT {_FLAGGED} FROM (SELECT doc_id, lang, {_flags('text')} FROM documents))
        QUALIFY row_number() OVER (PARTITION BY lang, doc_id // 4 ORDER BY doc_id % 2, doc_id) = 1""",
    "committed_corpus": f"""SELECT run, CASE WHEN doc_id // 2 % 5 = 0 THEN 'test' ELSE 'train' END AS split, sample_id, lang AS activity,
        md5('Conclusion:' || chr(10) || trim(text, {BLANK_CHARS}) || chr(10) || chr(10) || 'Predicted Activity: ' || lang || chr(10)) AS output_md5
        FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'second' END AS run, CAST(doc_id // 2 AS VARCHAR) AS sample_id FROM documents)
        QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY run, doc_id) = 1""",
    "committed_records": """WITH r AS (SELECT 'part' || doc_id % 2 AS run, CASE WHEN doc_id // 2 % 5 = 0 THEN 'test' ELSE 'train' END AS split,
          n_chars % 100 / 100.0::DOUBLE AS confidence FROM documents)
        SELECT run, split, count(*) AS n, round(sum(confidence), 6) AS confidence, any_value(n_run) AS n_run
        FROM r JOIN (SELECT run, count(*) AS n_run FROM r GROUP BY ALL) USING (run) GROUP BY ALL""",
    "strict_request_texts": _on_relation(
        "SELECT sample_id, kind, i, j, md5(request) AS request_md5 FROM asked", MATCH + ", " + _asked(False).strip()
    ),
    "relaxed_request_texts": _on_relation(
        "SELECT sample_id, kind, i, j, md5(request) AS request_md5, auto_verdict FROM asked", MATCH + ", " + _asked(True).strip()
    ),
    "resumed_request_batches": _on_relation(
        """SELECT (row_number() OVER (ORDER BY request_id) - 1) // 64 AS batch, request_id, kind, length(request) AS n_chars, n_pairs
        FROM each ANTI JOIN first USING (request_id)""", MATCH + ", " + _asked(True).strip() + _CALLS,
    ),
    "answered_pairs": _on_relation(
        """SELECT sample_id, kind, i, j, CASE WHEN request_id < '8' THEN 'YES' ELSE 'NO, not the same' END AS response
        FROM (SELECT *, sha256(kind || chr(10) || request) AS request_id FROM asked) SEMI JOIN first USING (request_id)""",
        MATCH + ", " + _asked(True).strip() + _CALLS,
    ),
    "scoped_term_recall": _on_relation(
        """SELECT CASE WHEN grouping(c) = 0 THEN 'condition' WHEN grouping(gt_activity) = 0 THEN 'class' ELSE 'all' END AS scope,
          coalesce(c, gt_activity, 'all') AS value, count(*) AS n, round(avg(r), 6) AS sensor_term_recall
        FROM (SELECT *, CASE WHEN gt_activity = predicted_activity THEN 'correct' ELSE 'incorrect' END AS c FROM recall)
        GROUP BY GROUPING SETS ((), (c), (gt_activity))""", _RECALL,
    ),
    "evaluation_samples": _on_relation(
        """SELECT pos, sample_id, gt_activity, predicted_activity, CASE WHEN gt_activity = predicted_activity THEN 'Y' ELSE 'N' END AS ok,
          gen_n AS n_obs, gen_m AS n_inf, CASE WHEN gen_n > 0 THEN 'Y' ELSE 'N' END AS parsed
        FROM (SELECT *, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS total FROM sized)
        WHERE pos % 50 = 0 OR pos = total - 1"""
    ),
    "report_lines": _on_relation(
        """, shown AS (
          SELECT 'config' AS section, 0 AS ordinal, 'dataset|ucihar' AS line UNION ALL SELECT 'config', 1, 'model_id|m'
          UNION ALL SELECT 'config', 2, 'n_tokens|8'
          UNION ALL SELECT 'config', 3, 'n_cls_samples|' || count(*) FROM n
          UNION ALL SELECT 'config', 4, 'n_text_samples|' || count(*) FILTER (has_ref) FROM n
          UNION ALL SELECT 'classification', 0, 'accuracy|' || (SELECT printf('%.4f', avg((gt = pred)::INT)) FROM guess)
          UNION ALL SELECT 'classification', 1, 'macro_precision|' || printf('%.4f', avg(precision)) FROM rep WHERE label <> 'unknown'
          UNION ALL SELECT 'classification', 2, 'macro_recall|' || printf('%.4f', avg(recall)) FROM rep WHERE label <> 'unknown'
          UNION ALL SELECT 'classification', 3, 'macro_f1|' || printf('%.4f', avg(f1)) FROM rep WHERE label <> 'unknown'
          UNION ALL SELECT 'text', 0, 'sensor_term_recall|' || printf('%.4f', avg(r)) FROM recall
          UNION ALL SELECT 'conditioned', CASE WHEN c THEN 0 ELSE 1 END, CASE WHEN c THEN 'correct|' ELSE 'incorrect|' END || count(*)
              || '|' || printf('%.4f', avg(r)) FROM (SELECT r, gt_activity = predicted_activity AS c FROM recall) GROUP BY c
          UNION ALL SELECT 'graph', 0, 'ref_psr|' || printf('%.4f', avg((ref_n > 0)::INT)) FROM sized WHERE has_ref
          UNION ALL SELECT 'graph', 100, 'gs_f1|' || printf('%.4f', avg(gs_f1)) FROM gsf
          UNION ALL SELECT 'graph', 101, 'gs_precision|' || printf('%.4f', avg(gs_precision)) FROM gsf
          UNION ALL SELECT 'graph', 102, 'gs_recall|' || printf('%.4f', avg(gs_recall)) FROM gsf
          UNION ALL SELECT 'graph', 103, 'gs_n_scored|' || count(gs_f1) FROM gsf
          UNION ALL SELECT 'graph', 200, 'rcv_structural|' || printf('%.4f', avg(s)) FROM chain
          UNION ALL SELECT 'graph', 201, 'rcv_semantic|' || printf('%.4f', avg(m)) FROM chain
          UNION ALL SELECT 'graph', 202, 'rcv_combined|' || printf('%.4f', avg(m)) FROM chain
          UNION ALL SELECT 'graph', 300, 'gc_mean|' || printf('%.4f', avg(gc)) FROM gc
          UNION ALL SELECT 'classes', ordinal, label || '|' || printf('%.4f', precision) || '|' || printf('%.4f', recall) || '|'
              || printf('%.4f', f1) || '|' || support FROM rep
        )
        SELECT list_position(['config', 'classification', 'text', 'conditioned', 'graph', 'classes'], section) AS section_ordinal,
          section, CAST(ordinal AS BIGINT) AS ordinal, line FROM shown""",
        ", ".join([_GUESS, _report("guess", LABELS), _RECALL.strip(), GROUNDING.strip(), CHAIN.strip(), COVERAGE.strip()]),
    ),
    "shard_gaps": """WITH c AS (
          SELECT i, count(*) AS n FROM (
            SELECT event_id AS i FROM events WHERE event_id % 10 NOT IN (3, 4)
            UNION ALL SELECT event_id FROM events WHERE event_id % 25 IN (5, 6, 7, 13)) GROUP BY ALL
        ), wanted AS (SELECT unnest(range(0, (SELECT count(*) FROM events) + 5)) AS i),
        gone AS (SELECT i, i - row_number() OVER (ORDER BY i) AS g FROM wanted ANTI JOIN c USING (i)),
        many AS (SELECT i, n, i - row_number() OVER (ORDER BY i) AS g FROM c WHERE n > 1)
        SELECT 'missing' AS kind, min(i) AS first, max(i) AS last, 0 AS n FROM gone GROUP BY g
        UNION ALL SELECT 'doubled', min(i), max(i), CAST(sum(n) AS BIGINT) FROM many GROUP BY g""",
    "match_document": _on_relation(
        f"""SELECT 'ucihar' AS dataset,
          (SELECT count(*) FROM (SELECT CASE WHEN gw = pw OR gw = 5 OR pw = 5 THEN 0 WHEN gw = 6 OR pw = 6 THEN 999
            ELSE abs(gw - pw) END AS d FROM obs_pair) WHERE d <= 1) + (SELECT count(*) FROM inf_pair) + (SELECT count(*) FROM syn_pair) AS n_judge_calls,
          (SELECT string_agg(raw || ':' || m, ',' ORDER BY m DESC, raw) FROM (
            SELECT {SENSORS_LOWER}[s + 1] AS raw, count(*) AS m FROM (
              SELECT o.s FROM ref_obs o JOIN n USING (sample_id) WHERE has_gen
              UNION ALL SELECT o.s FROM gen_obs o JOIN n USING (sample_id) WHERE has_ref) WHERE s <> 4 GROUP BY ALL)) AS unresolved,
          stratum, count(*) AS n_total, count(*) FILTER (NOT snm_skipped) AS n_scored, count(*) FILTER (snm_skipped) AS n_skipped,
          {_rounded(SCORE_NAMES, 'avg({})')}
        FROM s2, unnest(CASE WHEN snm_skipped THEN ['all'] WHEN gt_activity = predicted_activity THEN ['all', 'correct']
          ELSE ['all', 'incorrect'] END) AS t(stratum) GROUP BY ALL""", SAMPLE_SCORES,
    ),
    "tolerant_lines": """SELECT CAST(doc_id AS VARCHAR) AS sample_id, source AS split, lang AS input, md5(text) AS output_md5
        FROM documents WHERE doc_id % 7 <> 3""",
    "first_inference_rows": f"""SELECT file, pos, coalesce(CASE WHEN doc_id % 5 <> 0 THEN doc_id END, pos)::VARCHAR AS sample_id
        FROM (SELECT doc_id, doc_id // {derived.FILE_ROWS} AS file,
              row_number() OVER (PARTITION BY doc_id // {derived.FILE_ROWS} ORDER BY doc_id) - 1 AS pos FROM documents)
        WHERE file % 4 < 2 ORDER BY file, pos LIMIT 75""",
    "written_results": """SELECT '{"doc_id":' || doc_id || ',"score":' || coalesce(CASE WHEN doc_id % 3 = 0 THEN n_chars END::VARCHAR, 'null') || '}' AS line
        FROM documents""",
}
