"""DuckDB SQL for the query catalogue, with the same names and types."""

from __future__ import annotations

from . import builders as P

KNOWN = "('click', 'view', 'purchase')"


def _uniform(seed: int, key: str, salt: str) -> str:
    return f"(cast(('0x' || md5('{seed}:{salt}:' || {key})[1:12]) AS BIGINT) / 281474976710656e0)"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rank(table: str, by: str, id_col: str, where: str = "true", name: str = "rn", seed: int = 42) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}:' || {id_col}), {id_col}) AS {name} FROM {table} WHERE {where}"


_SOLUTIONS = r"""s AS (SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id % 13 = 5 THEN 'no tags for ' || lang ELSE
  '<think>seen in ' || source || '</think> <answer>' ||
  CASE WHEN doc_id % 11 = 3 THEN '' WHEN doc_id % 7 = 2 THEN chr(10) || ' ' || lang || ' ' || chr(10) WHEN doc_id % 5 = 1 THEN 'xx' ELSE lang END ||
  '</answer> <Confidence>0.' || ((doc_id * 37) % 90 + 10) || '</Confidence>' END AS solution FROM documents)"""
_ANSWER = r"""CASE WHEN regexp_matches(solution, '(?s)<answer>(.*?)</answer>') THEN regexp_replace(regexp_extract(solution, '(?s)<answer>(.*?)</answer>', 1), '^\s+|\s+$', '', 'g') END"""
_THINK = r"""CASE WHEN regexp_matches(solution, '(?s)<think>.*?</think>') THEN regexp_extract(solution, '(?s)(<think>.*?</think>)', 1) END"""
_BEFORE = "replace(CASE WHEN contains(solution, '</think>') THEN left(solution, instr(solution, '</think>') - 1) ELSE solution END, '<think>', '')"
_CONF = r"""try_cast(nullif(regexp_extract({}, '(?i)<confidence>([\d.]+)</confidence>', 1), '') AS DOUBLE)"""
_BOXES = """b AS (SELECT l_orderkey, l_linenumber, l_returnflag, cast(l_partkey % 400 AS DOUBLE) AS x, cast(l_suppkey % 300 AS DOUBLE) AS y,
  l_quantity + 1 AS w, l_quantity * 2 + 3 AS h FROM lineitem)"""
_NORM = "lower(replace(replace({}, ' ', ''), '_', ''))"
_MAIN = """c AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS f FROM lineitem GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {}) AS k FROM c)"""
_MAIN_FIRST = _MAIN.format("n DESC, f, l_returnflag")
_U, _V = _uniform(7, "doc_id", "u"), _uniform(7, "doc_id", "v")
_REWRITE = f"""{_SOLUTIONS},
v AS (SELECT doc_id, solution, coalesce({_ANSWER}, '') IN ('en', 'de') AS known, {_U} AS u, {_V} AS v FROM s),
w AS (SELECT doc_id, {_CONF.format("solution")} AS before,
  round(CASE WHEN NOT known THEN 65e-2 + (85e-2 - 65e-2) * v WHEN u < 70e-2 THEN 78e-2 + (88e-2 - 78e-2) * v
             WHEN u < 90e-2 THEN 70e-2 + (78e-2 - 70e-2) * v ELSE 88e-2 + (95e-2 - 88e-2) * v END, 2) AS c, solution FROM v),
r AS (SELECT doc_id, before, CASE WHEN before IS NOT NULL THEN c END AS after FROM w)"""
_ELEMENTS = "e AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_FEW = f"few AS (SELECT vec_id FROM ({_rank('embeddings', 'label', 'vec_id')}) WHERE rn <= 4)"
_PROTOS = """mean AS (SELECT label, i, avg(x) AS x FROM e WHERE vec_id IN (SELECT vec_id FROM few) GROUP BY ALL),
size AS (SELECT label, sqrt(sum(x * x)) AS s FROM mean GROUP BY ALL),
proto AS (SELECT label, i, x / s AS x FROM mean JOIN size USING (label))"""
_NEAR = f"""{_ELEMENTS}, {_FEW}, {_PROTOS},
d AS (SELECT e.vec_id, e.label, p.label AS nearest, sqrt(sum((e.x - p.x) * (e.x - p.x))) AS d FROM e JOIN proto p USING (i) GROUP BY ALL),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nearest) AS k FROM d) WHERE k = 1)"""
_SIMILAR = f"""{_ELEMENTS}, {_FEW}, {_PROTOS},
d AS (SELECT e.vec_id, e.label, p.label AS closest, sum(e.x * p.x) AS s FROM e JOIN proto p USING (i) GROUP BY ALL),
sim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, closest) AS k FROM d) WHERE k = 1)"""
_AP = """d AS (SELECT l_orderkey AS image_id, l_returnflag AS cls, ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey AS det_id,
  round(l_discount * 10 + l_quantity / 100, 4) AS score, ((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 101) / 100e0 AS iou FROM lineitem),
t AS (SELECT *, unnest(range(50, 100, 5)) AS t FROM d),
f AS (SELECT *, iou >= t / 100e0 AND row_number() OVER (PARTITION BY image_id, cls, t ORDER BY (iou >= t / 100e0) DESC, score DESC, det_id) = 1 AS tp FROM t),
g AS (SELECT cls, count(*) AS n FROM (SELECT DISTINCT image_id, cls FROM d) GROUP BY ALL),
p AS (SELECT cls, t, det_id, score, tp, sum(tp::INT) OVER w AS a, count(*) OVER w AS b FROM f
      WINDOW w AS (PARTITION BY cls, t ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
v AS (SELECT cls, t, tp, a, max(a / b) OVER (PARTITION BY cls, t ORDER BY score DESC, det_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM p),
q AS (SELECT cls, t, env, floor(a * 100 / n) - CASE WHEN a = 1 THEN 0 ELSE floor((a - 1) * 100 / n) + 1 END + 1 AS levels FROM v JOIN g USING (cls) WHERE tp),
ap AS (SELECT cls, t, sum(levels * env) / 101 AS ap FROM q GROUP BY ALL)"""
_MATCH = f"""RECURSIVE {_BOXES},
bands(area, low, high) AS (VALUES ('all', 0e0, 1e300), ('small', 0e0, 1024e0), ('medium', 1024e0, 9216e0), ('large', 9216e0, 1e300)),
det AS (SELECT l_orderkey AS image, l_returnflag AS cls, x + l_linenumber % 4 AS x, y - l_linenumber % 4 AS y, w, h, round((x + y) / 700, 4) AS score,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY round((x + y) / 700, 4) DESC, l_linenumber, b.x, b.y, w, h) AS k,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, b.x, b.y, w, h) AS id FROM b),
gt AS (SELECT l_orderkey AS image, l_returnflag AS cls, x, y, w, h, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, x, y, w, h) AS i FROM b),
inner_ AS (SELECT d.image, d.cls, d.k, g.i, d.w * d.h AS da, g.w * g.h AS ga,
  greatest(least(d.x + d.w, g.x + g.w) - greatest(d.x, g.x), 0) * greatest(least(d.y + d.h, g.y + g.h) - greatest(d.y, g.y), 0) AS common
  FROM det d JOIN gt g ON d.image = g.image AND d.cls = g.cls),
cand AS (SELECT image, cls, k, area, list({{'real': ga BETWEEN low AND high, 'v': common / (da + ga - common), 'i': i}}) AS near
  FROM inner_, bands WHERE common / (da + ga - common) >= 50e-2 GROUP BY ALL),
todo AS (SELECT d.image, d.cls, d.k, t, a.area, coalesce(near, []) AS near FROM det d CROSS JOIN (SELECT unnest(range(50, 100, 5)) AS t) CROSS JOIN bands a
  LEFT JOIN cand c ON c.image = d.image AND c.cls = d.cls AND c.k = d.k AND c.area = a.area WHERE d.k <= 100),
state AS (SELECT image, cls, t, area, 0::BIGINT AS k, NULL::STRUCT("real" BOOLEAN, v DOUBLE, i BIGINT) AS hit, []::BIGINT[] AS taken FROM todo WHERE k = 1
  UNION ALL SELECT image, cls, t, area, k, hit, CASE WHEN hit IS NULL THEN taken ELSE list_append(taken, hit.i) END FROM
  (SELECT s.image, s.cls, s.t, s.area, n.k, list_max(list_filter(n.near, lambda c: c.v >= s.t / 100e0 AND NOT list_contains(s.taken, c.i))) AS hit, s.taken
   FROM state s JOIN todo n ON n.image = s.image AND n.cls = s.cls AND n.t = s.t AND n.area = s.area AND n.k = s.k + 1)),
seen AS (SELECT s.cls, s.t, s.area, d.score, d.id, hit IS NOT NULL AS tp FROM state s JOIN det d ON s.image = d.image AND s.cls = d.cls AND s.k = d.k JOIN bands a ON a.area = s.area
  WHERE CASE WHEN hit IS NULL THEN d.w * d.h BETWEEN low AND high ELSE hit.real END),
n AS (SELECT cls, area, count(*) FILTER (w * h BETWEEN low AND high) AS n FROM gt, bands GROUP BY ALL),
p AS (SELECT cls, t, area, tp, score, id, sum(tp::INT) OVER o AS a, count(*) OVER o AS b FROM seen WINDOW o AS (PARTITION BY cls, t, area ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
v AS (SELECT cls, t, area, tp, a, max(a / b) OVER (PARTITION BY cls, t, area ORDER BY score DESC, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM p),
q AS (SELECT cls, t, area, env, floor(a * 100 / n) - CASE WHEN a = 1 THEN 0 ELSE floor((a - 1) * 100 / n) + 1 END + 1 AS levels FROM v JOIN n USING (cls, area) WHERE tp),
ap AS (SELECT n.cls, u.t, n.area, CASE WHEN n > 0 THEN coalesce(sum(levels * env) / 101, 0) END AS ap
  FROM n CROSS JOIN (SELECT unnest(range(50, 100, 5)) AS t) u LEFT JOIN q ON q.cls = n.cls AND q.area = n.area AND q.t = u.t GROUP BY n.cls, u.t, n.area, n)"""
_ALL = _MATCH.replace(", ('small', 0e0, 1024e0), ('medium', 1024e0, 9216e0), ('large', 9216e0, 1e300)", "")
_STRATA = """d AS (SELECT doc_id, CASE WHEN doc_id % 101 = 7 THEN 'only_' || doc_id ELSE source || '_' || lang END AS stratum FROM documents),
n AS (SELECT stratum, count(*) AS n FROM d GROUP BY ALL),
k AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM d)"""
_QUOTA = """x AS (SELECT stratum, n * want / sum(n) OVER () AS e, want FROM many),
y AS (SELECT *, floor(e) AS f FROM x),
z AS (SELECT stratum, f, want - sum(f) OVER () AS missing, row_number() OVER (ORDER BY round(e - f, 9) DESC, stratum) AS place FROM y),
q AS (SELECT stratum, f + (place <= missing)::INT AS quota FROM z)"""
_CLASSES = """seen AS (SELECT DISTINCT CASE WHEN n_nationkey % 9 = 4 THEN 'odd ' || n_name ELSE n_name END AS category
  FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer GROUP BY ALL HAVING count(*) > (SELECT count(*) / count(DISTINCT c_nationkey) FROM customer)))"""
_MAIN_SELECT = "SELECT l_orderkey, l_returnflag, cast(n AS BIGINT) AS n FROM m WHERE k = 1"
_DETECT = f"replace({_quote(P.DETECT)}, '{{cls}}', p_type)"


def _records(solution: str) -> str:
    return f"""SELECT doc_id, {solution} AS solution, CASE WHEN lang = 'en' THEN 'ID' ELSE 'OOD' END AS type,
  CASE WHEN lang = 'en' THEN lang ELSE 'unknown' END AS category, lang AS original_category FROM documents"""


def _think(c: str) -> str:
    return f"'<think>' || replace({_quote(P.IDENTIFIED)}, '{{category}}', {c}) || '</think> <answer>' || {c} || '</answer>'"


def _pick(texts: list[str], u: str) -> str:
    return "CASE cast(floor(" + u + " * 5) AS INT) " + " ".join(f"WHEN {k} THEN replace({_quote(t)}, '{{category}}', lang)" for k, t in enumerate(texts)) + " END"


def _bands(z: str = "0e0") -> str:
    """Confidence target from similarity ``s`` with noise ``z``."""
    bands = [("85e-2", "30e-2", "33e-2", "15e-3", "300e-3", "349e-3"), ("70e-2", "25e-2", "33e-2", "20e-3", "25e-2", "30e-2"), ("55e-2", "20e-2", "33e-2", "20e-3", "20e-2", "25e-2"), ("40e-2", "18e-2", "27e-2", "15e-3", "18e-2", "22e-2")]
    each = " ".join(f"WHEN s > {above} THEN round(greatest({low}, least({high}, {base} + {slope} * (s - {above}) + {sd} * {z})), 3)" for above, base, slope, sd, low, high in bands)
    return f"CASE {each} ELSE round(greatest(15e-2, least(20e-2, 15e-2 + 5e-2 * (s / 40e-2) + 15e-3 * {z} - CASE WHEN s < 30e-2 THEN 1e-2 ELSE 0e0 END)), 3) END"


_DISTANCES = """e AS (SELECT event_id, event_type, CASE WHEN event_id % 29 = 7 THEN 'cannot read ' || event_id END AS error, round(cast(floor(value * 100) AS BIGINT) % 40 / 100e0, 4) AS d FROM events),
x AS (SELECT event_id, event_type, CASE WHEN error IS NULL THEN d ELSE 5e-1 END AS distance, CASE WHEN error IS NULL THEN event_type ELSE 'unknown' END AS nearest_id,
  CASE WHEN error IS NULL THEN event_type ELSE 'unknown' END AS true_category, error FROM e)"""

ORACLES = {
    "kshot_per_class": f"SELECT event_type, event_id, rn FROM ({_rank('events', 'event_type', 'event_id')}) WHERE rn <= 4",
    "kshot_nested_5_of_8": f"SELECT event_type, event_id, rn FROM ({_rank('events', 'event_type', 'event_id')}) WHERE rn <= 5",
    "shot_deficit_report": """SELECT n_name, count(s_suppkey) AS n, greatest(0, 5 - count(s_suppkey)) AS deficit FROM nation
LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""",
    "ood_ratio_target": f"""WITH conf AS (SELECT * FROM (VALUES (1, 25e-2, 5), (2, 25e-2, 9), (4, 40e-2, 30), (5, 38e-2, 35), (8, 35e-2, 40), (10, 32e-2, 50), (16, 30e-2, 68)) c(k, r, m)),
a AS (SELECT count(*) AS available FROM events WHERE event_type NOT IN {KNOWN}),
x AS (SELECT i.k::BIGINT AS k, i.k::BIGINT * 14 AS n_id, coalesce(r, 20e-2) AS ood_ratio, coalesce(m, 20) AS m FROM (SELECT unnest(range(1, 17)) AS k) i LEFT JOIN conf USING (k)),
y AS (SELECT k, n_id, ood_ratio, greatest(cast(floor(n_id * ood_ratio / greatest(1e-6, 1 - ood_ratio)) AS BIGINT), m::BIGINT) AS target FROM x)
SELECT k, n_id, ood_ratio, target, least(target, available) AS capped FROM y, a""",
    "ood_balanced_sample": f"""WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || event_type), event_type) AS pick, sum(n) OVER () AS total, least(floor(count(*) OVER () * 70e-2), count(*) OVER ()) AS covered FROM n),
e AS (SELECT event_type, (pick <= covered)::INT AS first, CASE WHEN 30 > covered THEN greatest(1, floor((30 - covered) * n / total)) ELSE 0 END AS extra FROM c),
r AS ({_rank('events', 'event_type', 'event_id')}),
x AS (SELECT event_type, event_id, rn, CASE WHEN rn <= first THEN 1 ELSE 2 END AS round FROM r JOIN e USING (event_type) WHERE rn <= first + extra)
SELECT event_type, event_id, round::BIGINT AS round, pos FROM (SELECT *, row_number() OVER (ORDER BY round, event_type, rn) AS pos FROM x) WHERE pos <= 30""",
    "ood_equal_quota": f"SELECT source, doc_id, rn FROM ({_rank('documents', 'source', 'doc_id', 'lang <> $$en$$')}) WHERE rn <= 3",
    "ood_running_budget": """WITH c AS (SELECT o_orderpriority, count(*) AS n, least(count(*), 1200) AS raw FROM orders GROUP BY ALL),
s AS (SELECT *, sum(raw) OVER (ORDER BY o_orderpriority ROWS UNBOUNDED PRECEDING) AS cum FROM c)
SELECT o_orderpriority, n, raw, cast(least(cum, 4000) - least(cum - raw, 4000) AS BIGINT) AS take FROM s""",
    "ood_budgeted_sample": f"""WITH c AS (SELECT o_orderpriority, least(count(*), 40) AS raw FROM orders GROUP BY ALL),
s AS (SELECT *, sum(raw) OVER (ORDER BY o_orderpriority ROWS UNBOUNDED PRECEDING) AS cum FROM c),
g AS (SELECT o_orderpriority, least(cum, 130) - least(cum - raw, 130) AS take FROM s)
SELECT o_orderpriority, o_orderkey, rn FROM ({_rank('orders', 'o_orderpriority', 'o_orderkey')}) JOIN g USING (o_orderpriority) WHERE rn <= take""",
    "split_per_class": f"""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY ALL)
SELECT doc_id, source, CASE WHEN n >= 2 AND rn <= ceil(n * 20e-2) THEN 'val' ELSE 'train' END AS split FROM ({_rank('documents', 'source', 'doc_id')}) JOIN n USING (source)""",
    "split_stratified_singletons": f"""WITH {_STRATA}, many AS (SELECT stratum, n, ceil(sum(n) OVER () * 20e-2) AS want FROM n WHERE n >= 2), {_QUOTA}
SELECT doc_id, stratum, CASE WHEN rn <= coalesce(quota, 0) THEN 'test' ELSE 'train' END AS split FROM k LEFT JOIN q USING (stratum)""",
    "subsample_stratified": f"""WITH {_STRATA}, one AS (SELECT count(*) AS c FROM n WHERE n = 1),
many AS (SELECT stratum, n, greatest(0, least(200 - c, sum(n) OVER ())) AS want FROM n, one WHERE n >= 2), {_QUOTA}
SELECT doc_id, stratum FROM k JOIN (SELECT * FROM q UNION ALL SELECT stratum, 1 FROM n WHERE n = 1) USING (stratum) WHERE rn <= quota""",
    "support_query_role": f"""SELECT event_type, event_id, CASE WHEN event_type IN {KNOWN} AND rn <= 4 THEN 'support' ELSE 'query' END AS role,
CASE WHEN event_type IN {KNOWN} THEN round(CASE WHEN rn <= 1 THEN 75e-2 + (85e-2 - 75e-2) * u ELSE 88e-2 + (98e-2 - 88e-2) * u END, 2) END AS confidence
FROM (SELECT *, {_uniform(42, 'event_id', 'id')} AS u FROM ({_rank('events', 'event_type', 'event_id')})) WHERE rn <= 8""",
    "global_shuffle_positions": "SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) - 1 AS pos FROM events",
    "batch_assignment": """SELECT cast(floor(pos / 10) AS BIGINT) AS batch, count(*) AS n, round(sum(value), 6) AS value
FROM (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) GROUP BY 1""",
    "first_examples": "SELECT doc_id, left(text, 120) AS shown FROM documents ORDER BY doc_id LIMIT 15",
    "main_class_first_seen": f"WITH {_MAIN_FIRST} {_MAIN_SELECT}",
    "main_class_last_name": f"WITH {_MAIN.format('n DESC, l_returnflag DESC')} {_MAIN_SELECT}",
    "main_class_latest": f"WITH {_MAIN.format('l_returnflag DESC')} {_MAIN_SELECT}",
    "main_class_filter_boxes": f"""WITH {_MAIN_FIRST} SELECT p_brand, l.l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS quantity
FROM lineitem l JOIN m ON l.l_orderkey = m.l_orderkey AND l.l_returnflag = m.l_returnflag AND m.k = 1 JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "box_xywh": f"WITH {_BOXES} SELECT l_orderkey, l_linenumber, x AS b0, y AS b1, (x + w) - x AS b2, (y + h) - y AS b3 FROM b",
    "box_xyxy_scale1000": f"""WITH {_BOXES} SELECT l_orderkey, l_linenumber, cast(round_even(x / 640 * 1000, 0) AS BIGINT) AS x1, cast(round_even(y / 400 * 1000, 0) AS BIGINT) AS y1,
cast(round_even((x + w) / 640 * 1000, 0) AS BIGINT) AS x2, cast(round_even((y + h) / 400 * 1000, 0) AS BIGINT) AS y2 FROM b""",
    "box_area": f"WITH {_BOXES} SELECT l_returnflag, count(*) AS n, round(sum(w * h), 6) AS area FROM b GROUP BY ALL",
    "detection_records": f"""WITH {_BOXES}, {_MAIN_FIRST},
x AS (SELECT b.*, row_number() OVER (PARTITION BY b.l_orderkey ORDER BY l_linenumber, x, y, w, h) AS r, count(*) OVER (PARTITION BY b.l_orderkey) AS n
      FROM b JOIN m ON b.l_orderkey = m.l_orderkey AND b.l_returnflag = m.l_returnflag AND m.k = 1)
SELECT 'img_' || l_orderkey || '.jpg' AS image, l_returnflag AS category, n, cast(round_even(x / 640 * 1000, 0) AS BIGINT) AS p0, cast(round_even(y / 400 * 1000, 0) AS BIGINT) AS p1,
cast(round_even((x + w) / 640 * 1000, 0) AS BIGINT) AS p2, cast(round_even((y + h) / 400 * 1000, 0) AS BIGINT) AS p3 FROM x JOIN orders ON o_orderkey = l_orderkey WHERE r = 1""",
    "answer_tag_extract": f"""WITH {_SOLUTIONS} SELECT doc_id, {_ANSWER} AS answer, {_THINK} AS think, {_BEFORE} AS before, {_CONF.format("solution")} AS confidence FROM s""",
    "answer_accuracy": f"""WITH {_SOLUTIONS}, x AS (SELECT {_NORM.format(_ANSWER)} AS a, {_NORM.format("lang")} AS t FROM s WHERE n_chars >= 300),
y AS (SELECT count(*) FILTER (contains(a, t) OR contains(t, a)) AS correct, count(*) FILTER ((contains(a, t) OR contains(t, a)) AND a <> '' AND t <> '') AS strict_correct FROM x)
SELECT correct, (SELECT count(*) FROM documents) AS total, round(100 * correct / (SELECT count(*) FROM documents), 6) AS accuracy, strict_correct FROM y""",
    "title_tag_extract": r"""SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<title>(.*?)</title>') THEN regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '^\s+|\s+$', '', 'g') END AS title FROM pages""",
    "path_label": r"""WITH x AS (SELECT page_id, regexp_replace(split_part(url, '?', 1), '#.*$', '') AS p FROM pages)
SELECT page_id, string_split(p, '/')[-2] AS parent, regexp_extract(p, '([^/]+)$', 1) AS base, regexp_replace(regexp_extract(p, '([^/]+)$', 1), '\.[^.]*$', '') AS stem,
lower(regexp_extract(p, '(\.[^./]*)$', 1)) AS suffix, CASE WHEN regexp_matches(p, '/en/([^/]+)/') THEN regexp_extract(p, '/en/([^/]+)/', 1) END AS after_en FROM x""",
    "prompt_category_extract": f"SELECT p_partkey, p_type AS category, length({_DETECT}) AS n_chars FROM part",
    "json_metadata_route": f"""WITH x AS (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events),
y AS (SELECT event_type, CASE WHEN k < 10 THEN NULL WHEN k < 30 THEN 'unknown' ELSE event_type END AS c FROM x)
SELECT CASE WHEN c IS NULL THEN 'invalid' WHEN c = 'unknown' THEN 'ood' WHEN c IN {KNOWN} THEN 'id' ELSE 'invalid' END AS route, event_type, count(*) AS n FROM y GROUP BY ALL""",
    "label_canonicalise": """WITH m AS (SELECT n_nationkey, ' ' || lower(replace(n_name, 'I', '_I')) || CASE WHEN n_nationkey % 6 = 5 THEN 'zz' ELSE '-' END AS seen FROM nation),
x AS (SELECT lower(replace(replace(replace(n_name, ' ', ''), '_', ''), '-', '')) AS k, n_name, CASE WHEN n_regionkey < 2 THEN 'id' ELSE 'ood_train' END AS role FROM nation)
SELECT n_nationkey, seen, n_name AS canonical, coalesce(role, 'unknown') AS role FROM m LEFT JOIN x ON k = lower(replace(replace(replace(seen, ' ', ''), '_', ''), '-', ''))""",
    "alias_rewrite": "SELECT doc_id, '<answer>' || CASE WHEN doc_id % 3 = 0 THEN 'fishing_boat' ELSE lang END || '</answer>' AS solution, doc_id % 3 = 0 AS changed FROM documents",
    "lookup_defaults": "SELECT CASE lang WHEN 'en' THEN 'Easy' WHEN 'de' THEN 'Medium' WHEN 'fr' THEN 'Hard' ELSE 'Unknown' END AS difficulty, count(*) AS n FROM documents GROUP BY ALL",
    "record_build_answer": _records("'<answer>' || CASE WHEN lang = 'en' THEN lang ELSE 'unknown' END || '</answer>'"),
    "record_build_think": _records(_think("lang")),
    "record_build_confidence": _records(f"'<confidence></confidence> ' || {_think('lang')} || ' <confidence>' || printf('%.2f', round(5e-1 + {_uniform(42, 'doc_id', 'conf')} / 2, 2)) || '</confidence>'"),
    "record_build_varied_think": _records(
        f"'<think>' || CASE WHEN lang = 'en' THEN {_pick(P.ID_THOUGHTS, _uniform(42, 'doc_id', 'thought'))} ELSE {_pick(P.OOD_THOUGHTS, _uniform(42, 'doc_id', 'thought'))} END || '</think> <answer>' || CASE WHEN lang = 'en' THEN lang ELSE 'unknown' END || '</answer>'"
    ),
    "prompt_from_classes": "SELECT 'one of ' || string_agg(n_name, ', ' ORDER BY n_nationkey) || ', unknown' AS problem FROM nation",
    "confidence_rewrite": f"WITH {_REWRITE} SELECT doc_id, before, after FROM r",
    "confidence_histogram": f"""WITH {_REWRITE}, h AS (SELECT CASE WHEN after < 65e-2 THEN NULL WHEN after < 70e-2 THEN 0 WHEN after < 75e-2 THEN 1 WHEN after < 80e-2 THEN 2 WHEN after < 85e-2 THEN 3
WHEN after < 90e-2 THEN 4 WHEN after <= 95e-2 THEN 5 END AS bin FROM r WHERE after IS NOT NULL)
SELECT bin::BIGINT AS bin, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM h GROUP BY ALL""",
    "confidence_before_after": f"""WITH {_REWRITE} SELECT before IS DISTINCT FROM after AS changed, count(*) AS n, round(avg(before), 6) AS before_avg, round(avg(after), 6) AS after_avg,
round(stddev_pop(after), 6) AS after_sd FROM r GROUP BY ALL""",
    "confidence_frequencies": f"WITH {_REWRITE} SELECT after, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM r WHERE after IS NOT NULL GROUP BY ALL",
    "prototype_centroid": f"WITH {_ELEMENTS} SELECT label::BIGINT AS label, i, round(avg(x), 6) AS x FROM e GROUP BY ALL",
    "nearest_prototype": f"""WITH {_NEAR} SELECT label::BIGINT AS label, count(*) AS n, count(*) FILTER (nearest = label) AS correct, round(min(d), 6) AS d_min, round(avg(d), 6) AS d_avg,
round(max(d), 6) AS d_max FROM near GROUP BY ALL""",
    "nearest_prototype_rows": f"""WITH {_ELEMENTS}, proto AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
d AS (SELECT e.vec_id, p.label AS nearest, sqrt(sum((e.x - p.x) * (e.x - p.x))) AS d FROM e JOIN proto p USING (i) GROUP BY ALL)
SELECT vec_id, nearest::VARCHAR AS nearest, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nearest) AS k FROM d) WHERE k = 1""",
    "cosine_similarity_top1": f"WITH {_SIMILAR} SELECT vec_id, closest::VARCHAR AS closest, round(s, 6) AS similarity FROM sim",
    "pseudo_confidence": f"WITH {_SIMILAR}, z AS (SELECT vec_id, round(s, 6) AS s FROM sim) SELECT vec_id, {_bands()} AS confidence, round(greatest(1e-1, least(95e-2, 1 - s)), 3) AS ood_score FROM z",
    "difficulty_bucket": f"""WITH {_SIMILAR}, z AS (SELECT least(1e0, round(round(s, 16) * 2, 6)) AS s FROM sim)
SELECT CASE WHEN s > 75e-2 THEN 'Hard' WHEN s > 60e-2 THEN 'Medium' ELSE 'Easy' END AS difficulty, count(*) AS n FROM z GROUP BY ALL""",
    "own_prototype_similarity": f"""WITH {_ELEMENTS}, {_FEW}, {_PROTOS}, d AS (SELECT e.vec_id, e.label, sum(e.x * p.x) AS s FROM e JOIN proto p USING (label, i) WHERE vec_id IN (SELECT vec_id FROM few) GROUP BY ALL)
SELECT label::BIGINT AS label, count(*) AS n, round(avg(s), 6) AS own_similarity FROM d GROUP BY ALL""",
    "similarity_flags": f"WITH {_SIMILAR} SELECT label::BIGINT AS label, count(*) FILTER (s > 90e-2) AS very_similar, count(*) FILTER (s < 30e-2) AS very_far FROM sim GROUP BY ALL",
    "prototype_outlier_filtered": f"""WITH {_ELEMENTS}, mean AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
d AS (SELECT e.vec_id, e.label, round(sqrt(sum((e.x - m.x) * (e.x - m.x))), 9) AS d FROM e JOIN mean m USING (label, i) GROUP BY ALL),
lim AS (SELECT label, avg(d) + 2 * stddev_samp(d) AS lim, count(*) AS n FROM d GROUP BY ALL),
k AS (SELECT vec_id, label FROM d JOIN lim USING (label) WHERE d < lim),
again AS (SELECT e.label, i, avg(x) AS x, count(*) AS inliers FROM e JOIN k USING (vec_id) GROUP BY ALL),
both_ AS (SELECT m.label, m.i, coalesce(a.x, m.x) AS x, coalesce(a.inliers, 0) AS inliers FROM mean m LEFT JOIN again a USING (label, i)),
size AS (SELECT label, sqrt(sum(x * x)) AS s FROM both_ GROUP BY ALL)
SELECT label::BIGINT AS label, n, inliers, i, round(x / s, 6) AS x FROM both_ JOIN size USING (label) JOIN lim USING (label)""",
    "label_position": "SELECT label::BIGINT AS label, count(*) AS n, round(median(embedding[1]::DOUBLE), 6) AS x, round(median(embedding[2]::DOUBLE), 6) AS y FROM embeddings GROUP BY ALL HAVING count(*) >= 3",
    "separation_report": f"""WITH {_NEAR}, x AS (SELECT label, round(d, 6) AS d FROM near),
y AS (SELECT count(*) FILTER (label < 5) AS id_n, count(*) FILTER (label >= 5) AS ood_n, min(d) FILTER (label < 5) AS id_min, max(d) FILTER (label < 5) AS id_max, avg(d) FILTER (label < 5) AS id_avg,
min(d) FILTER (label >= 5) AS ood_min, max(d) FILTER (label >= 5) AS ood_max, avg(d) FILTER (label >= 5) AS ood_avg FROM x),
z AS (SELECT *, ood_min - id_max AS gap FROM y)
SELECT id_n, ood_n, round(id_min, 6) AS id_min, round(id_max, 6) AS id_max, round(id_avg, 6) AS id_avg, round(ood_min, 6) AS ood_min, round(ood_max, 6) AS ood_max, round(ood_avg, 6) AS ood_avg,
round(gap, 6) AS gap, round(CASE WHEN gap > 0 THEN id_max + 3e-1 * gap END, 6) AS unknown_mid, round(CASE WHEN gap > 0 THEN ood_min - 2e-1 * gap END, 6) AS unknown_high,
round(CASE WHEN gap > 0 THEN id_max + 2e-1 * gap END, 6) AS threshold_mid, round(CASE WHEN gap > 0 THEN ood_min - 2e-1 * gap END, 6) AS threshold_high FROM z""",
    "distance_distribution": """WITH x AS (SELECT cast(floor(value * 100) AS BIGINT) % 40 / 100e0 AS d FROM events WHERE value IS NOT NULL),
h AS (SELECT CASE WHEN d < 0 THEN NULL WHEN d < 10e-2 THEN 0 WHEN d < 12e-2 THEN 1 WHEN d < 14e-2 THEN 2 WHEN d < 16e-2 THEN 3 WHEN d < 18e-2 THEN 4 WHEN d < 20e-2 THEN 5
WHEN d < 22e-2 THEN 6 WHEN d < 25e-2 THEN 7 ELSE 8 END AS bin FROM x)
SELECT bin::BIGINT AS bin, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM h GROUP BY ALL""",
    "upper_median": """SELECT event_type, value AS upper_median FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k,
count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE k = n // 2 + 1""",
    "ap_single_gt": f"WITH {_AP} SELECT cls, t, round(ap, 6) AS ap FROM ap",
    "ap_per_class": f"WITH {_AP} SELECT cls, round(100 * max(ap) FILTER (t = 50), 6) AS ap50, round(100 * avg(ap), 6) AS map FROM ap GROUP BY ALL",
    "ap_summary": f'WITH {_AP} SELECT round(avg(ap), 6) AS "mAP", round(avg(ap) FILTER (t = 50), 6) AS "AP50", round(avg(ap) FILTER (t = 75), 6) AS "AP75" FROM ap',
    "ap_multi_gt": f"WITH {_MATCH} SELECT cls AS category_id, t, round(ap, 6) AS ap FROM ap WHERE area = 'all'",
    "ap_by_detections": " UNION ALL ".join(f"SELECT * FROM (WITH {_ALL.replace('d.k <= 100', f'd.k <= {n}')} SELECT cls AS category_id, cast({n} AS BIGINT) AS max_dets, t, round(ap, 6) AS ap FROM ap)" for n in (1, 2, 100)),
    "ap_by_area": f"""WITH {_MATCH} SELECT area, round(avg(ap), 6) AS "mAP", round(avg(ap) FILTER (t = 50), 6) AS "AP50", round(avg(ap) FILTER (t = 75), 6) AS "AP75"
FROM ap WHERE area <> 'all' GROUP BY ALL""",
    "ap_six_metrics": f"""WITH {_MATCH} SELECT round(avg(ap) FILTER (area = 'all'), 6) AS "mAP", round(avg(ap) FILTER (area = 'all' AND t = 50), 6) AS "AP50",
round(avg(ap) FILTER (area = 'all' AND t = 75), 6) AS "AP75", round(avg(ap) FILTER (area = 'small'), 6) AS "AP_small", round(avg(ap) FILTER (area = 'medium'), 6) AS "AP_m",
round(avg(ap) FILTER (area = 'large'), 6) AS "AP_l" FROM ap""",
    "map_selected": f"WITH {_AP}, m AS (SELECT cls, 100 * avg(ap) AS map FROM ap GROUP BY ALL) SELECT round(coalesce(sum(map), 0) / 3, 6) AS mean_ap FROM m WHERE cls IN ('A', 'R', 'Z')",
    "results_to_rows": f"""WITH {_BOXES} SELECT l_orderkey AS image_id, CASE l_returnflag WHEN 'A' THEN 10 WHEN 'N' THEN 20 ELSE 30 END::BIGINT AS category_id,
x AS b0, y AS b1, round((x + w) - x, 6) AS b2, round((y + h) - y, 6) AS b3, l_linenumber::DOUBLE AS score FROM b""",
    "audit_integrity": """WITH n AS (SELECT event_type, count(*) AS n, max(event_id) - min(event_id) + 1 = count(*) AND count(DISTINCT event_id) = count(*) AS whole FROM events GROUP BY ALL),
k AS (SELECT event_type FROM n WHERE event_type <> 'click' UNION ALL SELECT 'kayak'),
f AS (SELECT coalesce(n.event_type, k.event_type) AS category, CASE WHEN k.event_type IS NULL THEN 'invalid' WHEN n IS NULL THEN 'missing' WHEN n <> 2000 THEN 'count' END AS issue, coalesce(n, 0) AS n
      FROM n FULL JOIN k ON n.event_type = k.event_type)
SELECT category, issue, n FROM f WHERE issue IS NOT NULL UNION ALL SELECT event_type, 'gap', n FROM n WHERE NOT whole""",
    "audit_contiguity": "SELECT l_orderkey, count(*) AS n, max(l_linenumber) - min(l_linenumber) + 1 = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY ALL",
    "index_gaps": """SELECT event_type, count(*) AS gaps, max(event_id - p) AS widest FROM (SELECT event_type, event_id, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events)
WHERE event_id - p <> 1 GROUP BY ALL""",
    "audit_labels": """WITH x AS (SELECT toxic = 1 AS ood, CASE WHEN quality = 1 THEN '<answer>' || lang || '</answer>' ELSE '<answer>unknown</answer>' END AS s FROM documents JOIN labels USING (doc_id)),
y AS (SELECT count(*) FILTER (NOT ood) AS n_id, count(*) FILTER (ood) AS n_ood, count(*) FILTER (ood AND NOT contains(s, '<answer>unknown</answer>')) AS ood_mislabelled,
round(avg(length(s)) FILTER (NOT ood), 4) AS id_avg_length, round(avg(length(s)) FILTER (ood), 4) AS ood_avg_length, max(length(s)) AS max_length FROM x)
SELECT *, round(100 * n_ood / nullif(n_id + n_ood, 0), 4) AS ood_pct, CASE WHEN n_ood < 10 THEN 'too few unknown rows' WHEN ood_mislabelled > 0 THEN 'unknown rows without unknown label'
WHEN max_length > 150 THEN 'solutions too long' ELSE 'ok' END AS diagnosis FROM y""",
    "audit_length": "SELECT lang, count(*) AS n, min(length(text)) AS shortest, round(avg(length(text)), 6) AS mean, max(length(text)) AS longest FROM documents GROUP BY ALL",
    "source_readiness": """WITH x AS (SELECT 'events' AS source, event_type AS c, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'documents', source, count(*) FROM documents GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS rows, count(*) AS classes, count(*) FILTER (n < 50) AS short_classes FROM x GROUP BY ALL""",
    "set_invalid_classes": f"WITH {_CLASSES} SELECT category FROM seen EXCEPT SELECT n_name FROM nation",
    "set_missing_classes": f"WITH {_CLASSES} SELECT n_name AS category FROM nation EXCEPT SELECT category FROM seen",
    "set_partition_check": """WITH p AS (SELECT CASE WHEN n_regionkey < 3 THEN 'id' ELSE 'ood' END AS part, n_name AS c FROM nation WHERE n_name <> 'CHINA'
UNION ALL SELECT 'id', CASE WHEN n_nationkey = 3 THEN 'NOWHERE' ELSE n_name END FROM nation WHERE n_nationkey IN (3, 8)),
q AS (SELECT c, count(DISTINCT part) AS k FROM p GROUP BY ALL)
SELECT (SELECT count(*) FROM q WHERE k > 1) AS overlapping, (SELECT count(*) FROM nation WHERE n_name NOT IN (SELECT c FROM q)) AS missing,
(SELECT count(*) FROM q WHERE c NOT IN (SELECT n_name FROM nation)) AS invalid""",
    "taxonomy_partition_check": """SELECT scheme, overlapping::BIGINT AS overlapping, missing::BIGINT AS missing, invalid::BIGINT AS invalid
FROM (SELECT scheme, overlapping, missing + 30 - n AS missing, invalid + 30 - n AS invalid FROM (SELECT count(DISTINCT p_partkey % 30) AS n FROM part),
  (VALUES ('destroyer_id', 0, 0, 0), ('tugboat_id', 0, 0, 0), ('osr_near', 0, 0, 0), ('pseudo_ood', 0, 1, 1)) v(scheme, overlapping, missing, invalid))""",
    "union_id_ood": f"""SELECT 'id' AS kind, event_type, event_id FROM ({_rank('events', 'event_type', 'event_id', f'event_type IN {KNOWN}')}) WHERE rn <= 6
UNION ALL SELECT 'ood', event_type, event_id FROM ({_rank('events', 'event_type', 'event_id', f'event_type NOT IN {KNOWN}')}) WHERE rn <= 4""",
    "distinct_think": f"WITH {_SOLUTIONS} SELECT count(DISTINCT {_THINK}) AS thoughts, count(DISTINCT {_BEFORE}) AS before FROM s",
    "class_coverage": """SELECT seen, expected, round(seen / expected, 6) AS coverage FROM (SELECT count(*) AS seen FROM (SELECT c_nationkey FROM customer GROUP BY ALL HAVING count(*) > (SELECT count(*) / count(DISTINCT c_nationkey) FROM customer))),
(SELECT count(*) AS expected FROM nation)""",
    "running_accuracy": """WITH x AS (SELECT quality, cast(floor((row_number() OVER (ORDER BY doc_id) - 1) / 10) AS BIGINT) AS batch FROM labels),
y AS (SELECT batch, count(*) FILTER (quality = 1) AS c, count(*) AS t FROM x GROUP BY ALL),
z AS (SELECT batch, sum(c) OVER w AS correct, sum(t) OVER w AS total FROM y WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING))
SELECT batch, correct::BIGINT AS correct, total::BIGINT AS total, round(100 * correct / total, 6) AS accuracy FROM z WHERE (batch + 1) % 5 = 0""",
    "ordered_ids": """WITH x AS (SELECT event_type, min(event_id) AS f FROM events GROUP BY ALL)
SELECT event_type, row_number() OVER (ORDER BY f, event_type) - 1 AS by_appearance, row_number() OVER (ORDER BY event_type) - 1 AS by_name FROM x""",
    "shots_in_names": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 < 2 THEN n_nationkey::BIGINT END AS shots FROM nation",
    "number_truncation": "SELECT o_orderkey, cast(trunc(cast(printf('%.2f', o_totalprice / 1000) AS DOUBLE)) AS BIGINT) AS n FROM orders",
    "record_labels": f"""WITH {_SOLUTIONS}, x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND lang IN ('en', 'de', 'fr') THEN lang END AS a, {_ANSWER} AS b FROM s)
SELECT doc_id, coalesce(a, CASE WHEN b IN ('en', 'de', 'fr') THEN b END) AS label FROM x""",
    "encoded_contents": "SELECT p_partkey, to_base64(encode(p_name)) AS encoded FROM part",
    "task_prompts": f"""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN length({_quote(P.IDENTIFY)}) ELSE length({_DETECT}) END AS n_chars, p_size % 3 = 1 AS named
FROM part WHERE p_size % 3 < 2""",
    "distance_error_rows": f"WITH {_DISTANCES} SELECT event_id, distance, nearest_id, true_category, error FROM x",
    "distance_without_errors": f"""WITH {_DISTANCES} SELECT true_category, count(*) AS n, min(distance) AS low, max(distance) AS high, round(avg(distance), 6) AS mean
FROM x WHERE error IS NULL GROUP BY ALL""",
    "run_tally": f"WITH {_DISTANCES} SELECT event_type, count(*) FILTER (error IS NULL) AS succeeded, count(error) AS failed, count(*) AS total FROM x GROUP BY ALL",
    "answer_by_position": rf"""WITH {_SOLUTIONS}, x AS (SELECT doc_id, CASE WHEN doc_id % 17 = 4 THEN '</answer>' || solution ELSE solution END AS t FROM s)
SELECT doc_id, CASE WHEN contains(t, '<answer>') AND contains(t, '</answer>')
  THEN regexp_replace(substr(t, instr(t, '<answer>') + 8, greatest(0, instr(t, '</answer>') - instr(t, '<answer>') - 8)), '^\s+|\s+$', '', 'g') END AS answer FROM x""",
    "json_nested_path": "SELECT event_id, event_type AS category, try_cast(json_extract_string(props, '$.k') AS INT) AS k, NULL::VARCHAR AS missing FROM events",
    "record_build_plain": _records("lang"),
    "class_list_union": """SELECT row_number() OVER (ORDER BY n_regionkey >= 2, n_nationkey) - 1 AS pos, n_name AS category FROM nation""",
    "osr_records": f"""WITH {_SIMILAR},
r AS (SELECT 'v' || vec_id AS path, 'c' || label AS category, label, closest::VARCHAR AS closest, round(s, 6) AS s FROM sim),
k AS ({_rank('r', 'category', 'path')}), n AS (SELECT category, count(*) AS n FROM r GROUP BY ALL),
id AS (SELECT *, least(n, 8) AS used, {_uniform(42, 'path', 'id')} AS u FROM k JOIN n USING (category) WHERE label < 5 AND rn <= 8),
idc AS (SELECT *, round(CASE WHEN rn <= floor(used / 5) THEN 75e-2 + (85e-2 - 75e-2) * u ELSE 88e-2 + (98e-2 - 88e-2) * u END, 2) AS c FROM id),
cum AS (SELECT category, least(n, 6) AS raw, sum(least(n, 6)) OVER (ORDER BY category ROWS UNBOUNDED PRECEDING) AS cum FROM n JOIN (SELECT DISTINCT category, label FROM r) USING (category) WHERE label >= 5),
ood AS (SELECT *, sqrt(-2 * ln(greatest({_uniform(42, 'path', 'u')}, 1e-12))) * cos(2 * 3.141592653589793e0 * {_uniform(42, 'path', 'v')}) AS z
  FROM k JOIN cum USING (category) WHERE rn <= least(cum, 20) - least(cum - raw, 20)),
oodc AS (SELECT *, {_bands("z")} AS c FROM ood)
SELECT path AS image, '<answer>' || category || '</answer> <confidence>' || c || '</confidence>' AS solution, 'ID' AS type, category, NULL::VARCHAR AS closest_id, NULL::VARCHAR AS difficulty,
  CASE WHEN rn <= floor(used / 2) THEN 'support' ELSE 'query' END AS split, c AS confidence_target, NULL::DOUBLE AS pseudo_ood_score, NULL::DOUBLE AS max_similarity FROM idc
UNION ALL SELECT path, '<answer>unknown</answer> <confidence>' || printf('%.2f', c) || '</confidence>', 'OOD', category, closest,
  CASE WHEN s > 75e-2 THEN 'Hard' WHEN s > 60e-2 THEN 'Medium' ELSE 'Easy' END, 'query', c, round(greatest(1e-1, least(95e-2, 1 - s)), 3), s FROM oodc""",
}
