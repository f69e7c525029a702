"""DuckDB SQL for the registered queries, written from the operators' definitions.

The Spark side uses folds, broadcasts and column expressions; here are windows, recursion and CASE.
"""

from __future__ import annotations

from itertools import product

from .fixtures import WEIGHTS

K = "media_id, category, tag"
RULES = (
    "rules(category, tag, display, min_marker_duration, max_gap, required_duration, tag_threshold) AS (VALUES "
    "('engagement','view','Viewing',12.0::DOUBLE,6.0::DOUBLE,20.0::DOUBLE,0.5::DOUBLE), ('engagement','click','Clicking',36.0,12.0,72.0,0.4), "
    "('conversion','purchase','Buying',12.0,6.0,20.0,0.3), ('conversion','signup','Joining',0.0,6.0,0.0,0.5), ('system','error','Failing',0.0,6.0,20.0,0.5))"
)
RATE = "(media_id % 5 * 12.5 + 12.5)::DOUBLE"
FRAMES = (
    "frames AS (SELECT l_suppkey AS media_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, "
    "l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS n FROM lineitem)"
)
SCORES = (
    "e AS (SELECT vec_id AS media_id, label::DOUBLE AS frame_index, unnest(range(64))::INTEGER AS idx, "
    "1.0::DOUBLE / (1.0::DOUBLE + exp(-8.0::DOUBLE * unnest(embedding)::DOUBLE)) AS score FROM embeddings), "
    "tagged AS (SELECT media_id, frame_index, idx, 't' || idx AS tag, round_even(score, 2)::DOUBLE AS confidence FROM e WHERE score > 0.55::DOUBLE)"
)
ROUTED = "routed AS (SELECT media_id, 'c' || (idx % 3) AS category, tag, idx, frame_index, confidence FROM tagged WHERE idx < 63)"
STORED = (
    "stored AS (SELECT c_custkey AS media_id, category, 1.0::DOUBLE + c_custkey % 3 AS frame_interval, 0.1::DOUBLE * (c_custkey % 5) AS threshold, "
    "1.0::DOUBLE + c_custkey % 2 AS version, CASE WHEN c_custkey % 7 = 0 THEN 950 ELSE 200 + c_custkey % 4 END AS ai_model_id, 'f' || (c_custkey % 6) AS file_name "
    "FROM customer, (VALUES ('a'), ('b')) x(category) WHERE category = 'a' OR c_custkey % 4 <> 0)"
)
PLAN = (
    STORED + ", need AS (SELECT c_custkey AS media_id, x.category, s.media_id IS NOT NULL AS known, "
    "CASE WHEN s.media_id IS NULL THEN NULL WHEN 6.0::DOUBLE % s.frame_interval <> 0 OR 0.3::DOUBLE < s.threshold THEN 2 "
    "WHEN s.file_name = 'f1' AND s.version = 2 THEN 0 WHEN s.version = 2 AND 201 < s.ai_model_id AND s.ai_model_id >= 950 THEN 2 "
    "WHEN s.version = 2 AND 201 < s.ai_model_id THEN 1 WHEN s.version = 2 THEN 0 ELSE 2 END AS need "
    "FROM customer CROSS JOIN (VALUES ('a'), ('b')) x(category) LEFT JOIN stored s ON s.media_id = c_custkey AND s.category = x.category)"
)
HEADS = (
    "w AS (SELECT h, t, list_transform(range(64), lambda j: ((j * 37 + t * 11 + h * 5) % 13 - 6) / 10.0::DOUBLE) AS w FROM range(3) a(h), range(8) b(t)), "
    "scored AS (SELECT vec_id AS media_id, label::DOUBLE AS frame_index, t, 'm' || h AS model, 't' || h || '_' || t AS tag, 'c' || ((t + h) % 4) AS category, "
    "1.0::DOUBLE / (1.0::DOUBLE + exp(-(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * w[i])) + (t - 4) / 10.0::DOUBLE))) AS score FROM embeddings, w)"
)
NATIONS = (
    "models AS (SELECT n_name AS name, n_nationkey AS identifier, (n_nationkey % 3)::DOUBLE AS version, "
    "['c' || (n_nationkey % 7), 'd' || (n_nationkey % 5)] AS categories, CASE WHEN n_nationkey % 2 = 0 THEN 224 ELSE 384 END AS image_size, "
    "n_nationkey % 2 AS norm, 'p' || n_regionkey AS pipeline FROM nation)"
)
V0 = (
    "k AS (SELECT c_custkey AS media_id, CASE c_custkey % 3 WHEN 0 THEN 'old_one' WHEN 1 THEN 'old_two' ELSE 'unheard' END AS name, "
    "(c_custkey % 2 + 1)::DOUBLE AS was FROM customer)"
)


def det(decimals: int = 2) -> str:
    return (
        "det AS (SELECT user_id AS media_id, CASE WHEN event_type IN ('view','click') THEN 'engagement' WHEN event_type IN ('purchase','signup') "
        "THEN 'conversion' ELSE 'system' END AS category, event_type AS tag, floor((floor(epoch(ts)) - 1704067200) / 21600.0::DOUBLE) * 6.0::DOUBLE AS frame_index, "
        f"max(round(value / (value + 50.0::DOUBLE), {decimals})) AS confidence FROM events GROUP BY ALL)"
    )


def runs(decimals: int = 2, merge: float = 0.0, confidence: bool = True) -> str:
    same = "confidence IS NOT DISTINCT FROM lag(confidence) OVER w" if confidence else "true"
    return (
        f"{det(decimals)}, d1 AS (SELECT *, CASE WHEN frame_index - lag(frame_index) OVER w - 6.0::DOUBLE <= {merge} AND {same} THEN 0 ELSE 1 END AS o "
        f"FROM det WINDOW w AS (PARTITION BY {K} ORDER BY frame_index)), d2 AS (SELECT *, sum(o) OVER (PARTITION BY {K} ORDER BY frame_index) AS i FROM d1), "
        f'spans AS (SELECT {K}, min(frame_index) AS "start", CASE WHEN count(*) > 1 THEN max(frame_index) END AS "end", min(confidence) AS confidence FROM d2 GROUP BY {K}, i)'
    )


RULED = f'ruled AS (SELECT spans.*, coalesce("end", "start") AS pos, display, min_marker_duration, max_gap FROM spans JOIN rules USING (category, tag) WHERE confidence >= tag_threshold AND min_marker_duration > 0)'
WANTED = (
    f'{runs()}, {RULES}, {RULED}, m1 AS (SELECT *, CASE WHEN "start" - lag(pos) OVER w - 6.0::DOUBLE <= max_gap THEN 0 ELSE 1 END AS o FROM ruled WINDOW w AS (PARTITION BY {K} ORDER BY "start")), '
    f'm2 AS (SELECT *, sum(o) OVER (PARTITION BY {K} ORDER BY "start") AS i FROM m1), '
    f'm3 AS (SELECT {K}, i, min("start") AS "start", CASE WHEN count(*) > 1 THEN arg_max(pos, "start") ELSE max("end") END AS "end", max(min_marker_duration) AS least FROM m2 GROUP BY {K}, i), '
    f'wanted AS (SELECT {K}, "start", "end" FROM m3 WHERE "end" IS NOT NULL AND "end" - "start" >= least)'
)
BUCKETS = (
    'b0 AS (SELECT *, coalesce("end", "start") AS pos FROM spans WHERE confidence >= 0.3::DOUBLE), '
    f'b1 AS (SELECT *, CASE WHEN "start" - lag(pos) OVER w = 6.0::DOUBLE THEN 0 ELSE 1 END AS o FROM b0 WINDOW w AS (PARTITION BY {K} ORDER BY "start")), '
    f'b2 AS (SELECT *, sum(o) OVER (PARTITION BY {K} ORDER BY "start") AS i FROM b1), b3 AS (SELECT *, min("start") OVER (PARTITION BY {K}, i) AS f FROM b2), '
    f'p0 AS (SELECT {K}, min("start") AS s, max(pos) AS e, sum(confidence * (pos - f + 6.0::DOUBLE)) AS tc FROM b3 GROUP BY {K}, i)'
)


def passes(keys: str, dw: str, gf: str, af: str, mg: str, source: str = "p0", more: str = "") -> str:
    """Ten passes of pair merging, each as three windows."""
    w = f"WINDOW w AS (PARTITION BY {keys} ORDER BY s)"
    weight = lambda x: f"(({x}e - {x}s + 6.0::DOUBLE) * (1 + {dw} * ({x}tc / ({x}e - {x}s + 6.0::DOUBLE))))"
    a, b = weight(""), weight("n")
    out = []
    for k in range(1, 11):
        before = source if k == 1 else f"p{k - 1}"
        out.append(
            f"x{k} AS (SELECT *, lead(s) OVER w AS ns, lead(e) OVER w AS ne, lead(tc) OVER w AS ntc, row_number() OVER w AS rn FROM {before} {w}), "
            f"y{k} AS (SELECT *, coalesce(ns - e - 6.0::DOUBLE <= {mg} + (least({a}, {b}) + abs({a} - {b}) * {af}) * {gf}, false) AS m FROM x{k}), "
            f"z{k} AS (SELECT *, m AND (rn - 1 - coalesce(max(CASE WHEN NOT m THEN rn END) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 0 AS h FROM y{k}), "
            f"v{k} AS (SELECT *, coalesce(lag(h) OVER w, false) AS g FROM z{k} {w}), "
            f"p{k} AS (SELECT {keys}{more}, s, CASE WHEN h THEN ne ELSE e END AS e, CASE WHEN h THEN tc + ntc ELSE tc END AS tc FROM v{k} WHERE NOT g)"
        )
    return ", ".join(out)


DEFAULTS = ("0.04::DOUBLE", "0.85::DOUBLE", "0.25::DOUBLE", "0.0::DOUBLE")
MARKERS = f'{BUCKETS}, {passes(K, *DEFAULTS)}, markers AS (SELECT {K}, s AS "start", e AS "end", tc AS total_confidence FROM p10 WHERE e - s + 6.0::DOUBLE >= 12)'
BOTH = f"{WANTED}, {MARKERS}"
OVERLAP = f'ov AS (SELECT {", ".join("a." + c for c in K.split(", "))}, sum(least(a."end", d."end") - greatest(a."start", d."start")) AS shared FROM markers a JOIN wanted d USING ({K}) WHERE a."start" < d."end" AND d."start" < a."end" GROUP BY ALL)'
TOTALS = (
    f'{runs()}, {RULES}, t AS (SELECT {K}, sum(CASE WHEN confidence IS NULL OR confidence = 0 OR confidence >= tag_threshold THEN CASE WHEN "end" IS NULL THEN 6.0::DOUBLE ELSE "end" - "start" + 6.0::DOUBLE END END) AS total '
    f"FROM spans JOIN rules USING (category, tag) GROUP BY {K}), tot AS (SELECT m.media_id, r.category, r.tag, r.display, r.required_duration, coalesce(t.total, 0.0::DOUBLE) AS total "
    "FROM (SELECT DISTINCT user_id AS media_id FROM events) m CROSS JOIN rules r LEFT JOIN t ON t.media_id = m.media_id AND t.category = r.category AND t.tag = r.tag)"
)
FLAT = f'{K}, round("start", 6) AS "start", round("end", 6) AS "end"'


def grid(choices: dict[str, list[float]]) -> str:
    rows = ", ".join("(" + ", ".join(f"{x!r}::DOUBLE" for x in r) + ")" for r in sorted(set(product(*choices.values()))))
    names = ", ".join(choices)
    more, many = ", " + names, rows.count("(")  # keys and combinations are numbered: windows go by one number
    on = " AND ".join(f"x.{n} = g.{n}" for n in choices)
    return (
        f"WITH {WANTED}, {BUCKETS}, grid AS (SELECT *, row_number() OVER () - 1 AS g FROM (VALUES {rows}) x({names})), "
        f"kinds AS (SELECT {K}, row_number() OVER () * {many} AS kind FROM (SELECT DISTINCT {K} FROM p0)), "
        f"q0 AS (SELECT kind + g AS k, s, e, tc{more} FROM p0 JOIN kinds USING ({K}) CROSS JOIN grid), {passes('k', *choices, source='q0', more=more)}, "
        f'act AS (SELECT {K}, {names}, s AS "start", e AS "end" FROM p10 JOIN kinds ON kind = k - k % {many} WHERE e - s + 6.0::DOUBLE >= 12), '
        f"cnt AS (SELECT {names}, count(*) AS n FROM act GROUP BY ALL), "
        f'cov AS (SELECT {names}, sum("end" - "start") AS c FROM act WHERE ({K}) IN (SELECT ({K}) FROM wanted) GROUP BY ALL), '
        f'sh AS (SELECT {names}, sum(least(a."end", d."end") - greatest(a."start", d."start")) AS c FROM act a JOIN wanted d USING ({K}) WHERE a."start" < d."end" AND d."start" < a."end" GROUP BY ALL), '
        f'one AS (SELECT {", ".join("g." + n for n in choices)}, coalesce(cov.c, 0) + (SELECT coalesce(sum("end" - "start"), 0) FROM wanted) - 2 * coalesce(sh.c, 0) AS l, abs(coalesce(cnt.n, 0) - (SELECT count(*) FROM wanted)) AS mismatch '
        f"FROM grid g LEFT JOIN cnt ON {on.replace('x.', 'cnt.')} LEFT JOIN cov ON {on.replace('x.', 'cov.')} LEFT JOIN sh ON {on.replace('x.', 'sh.')}) "
        f"SELECT {names}, round(l + 2 * mismatch, 6) AS loss, mismatch FROM one ORDER BY round(l + 2 * mismatch, 6), {names} LIMIT 10"
    )


NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def num(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), {NUM}) THEN try_cast(trim({x}) AS DOUBLE) END"


def queries(choices: dict[str, list[float]]) -> dict[str, str]:
    cells = "('12'), ('12s'), ('5%'), ('abc'), (''), ('0'), ('-1'), ('5d'), ('1e2'), ('.5'), (' 7 '), ('10 %'), ('5% '), ('12ss'), (NULL)"
    fps_text = "CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_partkey || '/1001' WHEN 2 THEN '30/0' WHEN 3 THEN p_brand END"
    zip_path = "url || CASE page_id % 3 WHEN 0 THEN '/Set.ZIP\\a\\b.png' WHEN 1 THEN '/x.zip.zip//c.png' ELSE '/x.zipper/d.png' END"
    step = "CASE WHEN {i} > 0 THEN greatest(1, round_even({r} * {i}, 0)::BIGINT) ELSE 1 END"
    interval = "CASE WHEN media_id % 3 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END"
    rule = lambda x: f"SELECT {x} FROM rules"
    q = {
        "o51_rle_v1": f"WITH {runs(1)} SELECT {FLAT}, round(confidence, 6) AS confidence FROM spans",
        "o51_rle_v3": f"WITH {runs(2, 4.0, False)} SELECT {FLAT} FROM spans",
        "o47_rule_filter": f"WITH {runs()}, {RULES}, {RULED} SELECT {FLAT}, display, round(confidence, 6) AS confidence, max_gap FROM ruled",
        "o52_merge_gap": f"WITH {WANTED} SELECT {FLAT} FROM wanted",
        "o53_buckets": f"WITH {runs()}, {BUCKETS} SELECT {K}, s, e, round(tc, 6) AS tc FROM p0",
        "o53_cluster": f"WITH {runs()}, {MARKERS} SELECT {FLAT}, round(total_confidence, 6) AS total_confidence FROM markers",
        "o54_merge_prop": (
            f'WITH RECURSIVE {runs()}, {RULES}, {RULED}, o AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY "start") AS rn FROM ruled), '
            f'f AS (SELECT {K}, rn, 1 AS g, "start" AS s, "end" AS e, pos AS p, min_marker_duration AS least FROM o WHERE rn = 1 UNION ALL '
            f'SELECT {", ".join("o." + c for c in K.split(", "))}, o.rn, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN s ELSE o."start" END, CASE WHEN j THEN o.pos ELSE o."end" END, o.pos, least '
            f'FROM (SELECT f.*, o2."start" - f.p - 6.0::DOUBLE <= o2.max_gap OR o2."start" - f.p - 6.0::DOUBLE <= 0.5::DOUBLE * coalesce(f.e - f.s, 0) AS j FROM f JOIN o o2 ON o2.media_id = f.media_id AND o2.category = f.category AND o2.tag = f.tag AND o2.rn = f.rn + 1) f '
            f"JOIN o ON o.media_id = f.media_id AND o.category = f.category AND o.tag = f.tag AND o.rn = f.rn + 1), "
            f'r AS (SELECT {K}, g, max(s) AS "start", arg_max(e, CASE WHEN e IS NOT NULL THEN rn END) AS "end", max(least) AS least FROM f GROUP BY {K}, g) '
            f'SELECT {FLAT} FROM r WHERE "end" IS NOT NULL AND "end" - "start" >= least'
        ),
        "o55_totals": f"WITH {TOTALS} SELECT {K}, display, round(total, 6) AS total FROM tot",
        "o55_tags": f"WITH {TOTALS} SELECT DISTINCT media_id, category, display AS video_tag FROM tot WHERE required_duration > 0 AND total >= required_duration",
        "o56_measure": f'WITH {runs()}, {MARKERS} SELECT {K}, round(sum("end" - "start"), 6) AS covered FROM markers GROUP BY {K}',
        "o57_overlap": f"WITH {BOTH}, {OVERLAP} SELECT {K}, round(shared, 6) AS shared FROM ov",
        "o58_loss": (
            f'WITH {BOTH}, {OVERLAP}, a AS (SELECT {K}, sum("end" - "start") AS c FROM markers GROUP BY ALL), d AS (SELECT {K}, sum("end" - "start") AS c FROM wanted GROUP BY ALL) '
            f"SELECT {K}, round(coalesce(a.c, 0) + d.c - 2 * coalesce(shared, 0), 6) AS loss FROM d LEFT JOIN a USING ({K}) LEFT JOIN ov USING ({K})"
        ),
        "o59_count_mismatch": (
            f"WITH {BOTH}, a AS (SELECT media_id, count(*) AS a FROM markers GROUP BY ALL), d AS (SELECT media_id, count(*) AS d FROM wanted GROUP BY ALL) "
            "SELECT media_id, abs(coalesce(a, 0) - coalesce(d, 0)) AS mismatch FROM a FULL JOIN d USING (media_id)"
        ),
        "o60_grid": grid(choices),
        "o61_desired_lookup": (
            "SELECT user_id AS media_id, CASE WHEN event_type IN ('view', 'click') THEN 'engagement' ELSE 'Unknown' END AS category, "
            "CASE event_type WHEN 'view' THEN 'Viewing' WHEN 'click' THEN 'Clicking' ELSE event_type END AS tag, event_id::DOUBLE AS \"start\", (event_id + 12)::DOUBLE AS \"end\" FROM events"
        ),
        "o37_duration_literal": (
            f"SELECT n_nationkey, cell, round(CASE WHEN cell IS NULL THEN NULL WHEN right(cell, 1) = chr(37) THEN coalesce(({num('left(cell, length(cell) - 1)')}) / 100 * (n_nationkey * 100.0::DOUBLE), 0) "
            f"WHEN right(cell, 1) = 's' THEN coalesce({num('left(cell, length(cell) - 1)')}, 0) ELSE coalesce({num('cell')}, 0) END, 6) AS seconds FROM nation CROSS JOIN (VALUES {cells}) x(cell)"
        ),
        "o38_defaults": (
            "WITH n AS (SELECT *, n_nationkey AS k FROM nation) SELECT 'r' || n_regionkey AS category, n_name AS tag, n_name AS display, "
            + ", ".join(f"CASE (k + {i}) % 4 WHEN 2 THEN k::DOUBLE WHEN 3 THEN (k + {i}) / 100.0::DOUBLE * 500.0::DOUBLE ELSE {d} END::DOUBLE AS {n}" for i, (n, d) in enumerate((("min_marker_duration", 12), ("max_gap", 9), ("required_duration", 20))))
            + ", CASE WHEN k % 3 > 0 THEN ('0.' || k)::DOUBLE ELSE 0.5::DOUBLE END AS tag_threshold FROM n"
        ),
        "o39_rename": f"WITH {det()}, {RULES} SELECT display, count(*) AS n FROM det JOIN rules USING (category, tag) GROUP BY display",
        "o22_sample": f"WITH {FRAMES} SELECT media_id, n, {step.format(i='0.5::DOUBLE', r=RATE)} AS step FROM frames WHERE n % ({step.format(i='0.5::DOUBLE', r=RATE)}) = 0",
        "o24_timestamps": (
            f"WITH {FRAMES}, f AS (SELECT *, {step.format(i=interval, r=RATE)} AS step, {interval} AS i, {RATE} AS r FROM frames) "
            "SELECT media_id, n, round(CASE WHEN i > 0 THEN (n // step) * i ELSE n / r END, 6) AS seconds FROM f WHERE n % step = 0"
        ),
        "o25_ordinals": f"WITH {FRAMES} SELECT media_id, n, CASE media_id % 3 WHEN 0 THEN n WHEN 1 THEN n // 12 ELSE n // 12 * 12 END AS label FROM frames WHERE n % 12 = 0",
        "o26_target_rate": "WITH x AS (SELECT DISTINCT round(l_discount * 40 - 0.4::DOUBLE, 6) AS i FROM lineitem) SELECT i, round(CASE WHEN i > 0 THEN greatest(1 / i, 0.001) END, 6) AS rate FROM x",
        "o27_plain_decimal": "SELECT p_partkey, regexp_replace(printf('%.12f', p_retailprice / 8), '\\.?0+$', '') AS shown FROM part",
        "o28_vr_crop": (
            "WITH x AS (SELECT p_partkey, p_size * 10 + 1 AS h, (p_partkey % 900 + 1)::INTEGER AS w FROM part) SELECT p_partkey, 0 AS top, CASE WHEN w / h > 1.5 THEN h ELSE h // 2 END AS bottom, "
            'CASE WHEN w / h > 1.5 THEN w // 2 ELSE w // 4 END AS "left", CASE WHEN w / h > 1.5 THEN w ELSE 3 * w // 4 END AS "right" FROM x'
        ),
        "o29_middle": "SELECT p_partkey, (p_size + 1) // 2 AS middle FROM part",
        "o30_channels": (
            "SELECT vec_id, n, round(embedding[1]::DOUBLE, 6) AS r, CASE WHEN n = 2 THEN NULL ELSE round(embedding[CASE n WHEN 1 THEN 1 ELSE 2 END]::DOUBLE, 6) END AS g, "
            "CASE WHEN n = 2 THEN NULL ELSE round(embedding[CASE n WHEN 1 THEN 1 ELSE 3 END]::DOUBLE, 6) END AS b FROM embeddings CROSS JOIN (VALUES (1), (2), (3), (4)) x(n)"
        ).replace("round(embedding[1]::DOUBLE, 6) AS r", "CASE WHEN n = 2 THEN NULL ELSE round(embedding[1]::DOUBLE, 6) END AS r"),
        "o33_normalise": "WITH x AS (SELECT vec_id, embedding, unnest(range((len(embedding) - 1) // 3 + 1))::INTEGER AS pixel FROM embeddings) SELECT vec_id, pixel, "
        + ", ".join(
            f"round((abs(coalesce(embedding[pixel * 3 + {i + 1}]::DOUBLE, 0)) * 255.0 / 255.0 - {m[i]!r}) / {v[i]!r}, 6) AS p{p}_{i}"
            for p, (m, v) in {0: ([0.485, 0.456, 0.406], [0.229, 0.224, 0.225]), 1: ([0.48145466, 0.4578275, 0.40821073], [0.26862954, 0.26130258, 0.27577711])}.items()
            for i in range(3)
        )
        + " FROM x",
        "o34_shape": "SELECT p_partkey, CASE WHEN p_size % 5 = 3 AND p_partkey % 2 = 0 THEN NULL ELSE 'not 3x224x224' END AS error FROM part",
        "o40_batches": (
            "WITH x AS (SELECT p_partkey, p_retailprice / 7 * [1.0, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]::DOUBLE[][least(greatest(p_size % 10, 1), 7)] AS x FROM part) "
            "SELECT p_partkey, (CASE WHEN x < 8 THEN floor(x) WHEN floor(x) % 8 <= 5 THEN floor(x) - floor(x) % 8 ELSE floor(x) + 8 - floor(x) % 8 END)::BIGINT AS batch FROM x"
        ).replace("[1.0, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]::DOUBLE[][least", "([1.0, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]::DOUBLE[])[least"),
        "o02_zip_split": (
            f"WITH x AS (SELECT page_id, {zip_path} AS p FROM pages), a AS (SELECT *, nullif(regexp_extract(p, '(?i)^(.*?\\.zip)(?:[/\\\\]|$)', 1), '') AS archive FROM x) "
            "SELECT page_id, archive, CASE WHEN archive IS NOT NULL THEN ltrim(replace(substr(p, length(archive) + 2), '\\', '/'), '/') END AS member FROM a"
        ),
        "o05_normalise_path": "SELECT page_id, CASE WHEN trim(url) IN (SELECT trim(url) FROM pages WHERE page_id % 2 = 0) THEN trim(url) ELSE replace(trim(url), '/', '\\') END AS source FROM pages",
        "o06_url_scheme": (
            "WITH x AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN url WHEN 2 THEN substr(url, 9) WHEN 3 THEN '1x://y' END AS p FROM pages) "
            "SELECT page_id, CASE WHEN p IS NULL OR trim(p) = '' THEN 'empty path' WHEN regexp_matches(trim(p), '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN NULL WHEN trim(p) NOT IN (SELECT substr(url, 9) FROM pages WHERE page_id % 2 = 0 AND url IS NOT NULL) THEN 'not found' END AS error FROM x"
        ),
        "o07_duration": (
            "WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS s, CASE WHEN p_partkey % 5 <> 0 THEN p_size::DOUBLE END AS r, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey END AS f FROM part) "
            "SELECT p_partkey, round(coalesce(s, CASE WHEN r > 0 THEN f / r END, 0), 6) AS seconds FROM x"
        ),
        "o09_frame_rate": (
            f"WITH x AS (SELECT p_partkey, {fps_text} AS t FROM part) SELECT p_partkey, round(coalesce({num('t')}, CASE WHEN t LIKE '%/%' THEN ({num('split_part(t, chr(47), 1)')}) / "
            f"coalesce(nullif({num('split_part(t, chr(47), 2)')}, 0), 1) END, 30.0::DOUBLE), 6) AS rate FROM x"
        ),
        "o12_decoder": (
            "SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN NULL ELSE CASE p_partkey % 4 WHEN 0 THEN 'h264_cuvid' WHEN 1 THEN 'hevc_cuvid' WHEN 3 THEN 'vp9_cuvid' END END AS decoder, "
            "CASE WHEN p_size * 100 >= 3600 OR p_retailprice >= 1900 THEN 'gpu' ELSE 'cpu' END AS backend FROM part"
        ),
        "o41_linear_head": f"SELECT vec_id, round(1 / (1 + exp(-list_dot_product(embedding::DOUBLE[], {WEIGHTS!r}::DOUBLE[]))), 6) AS score FROM embeddings",
        "o43_threshold": f"WITH {SCORES} SELECT media_id, frame_index, idx, tag, round(confidence, 6) AS confidence FROM tagged",
        "o44_route": f"WITH {SCORES}, {ROUTED} SELECT media_id, category, tag, frame_index, round(confidence, 6) AS confidence FROM routed",
        "o45_image_rules": f"WITH {SCORES}, {ROUTED} SELECT media_id, category, 'Tag ' || idx AS tag, round(confidence, 6) AS confidence FROM routed WHERE idx < 6 AND confidence >= 0.4::DOUBLE + idx * 0.05::DOUBLE",
        "o46_passthrough": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 't,' || page_id ELSE '' END AS tags FROM pages",
        "o48_skip": "SELECT n_name AS name, n_nationkey % 7 < 3 AND n_nationkey % 5 < 2 AS skipped FROM nation",
        "o49_used_models": "SELECT n_name AS name, n_nationkey AS identifier, (n_nationkey % 3)::DOUBLE AS version FROM nation WHERE NOT (n_nationkey % 7 < 3 AND n_nationkey % 5 < 2)",
        "o72_coalesce": f"WITH {det()} SELECT media_id, frame_index, count(*) AS tags, count(DISTINCT category) AS categories FROM det GROUP BY ALL",
        "o73_await": f"WITH {det()} SELECT media_id, count(DISTINCT frame_index) AS frames, count(*) AS detections FROM det GROUP BY media_id",
        "o98_reprocess": f"WITH {PLAN} SELECT media_id, category, need FROM need",
        "o104_short_circuit": f"WITH {PLAN} SELECT media_id, count(*) AS skipped FROM need GROUP BY media_id HAVING NOT bool_or(NOT known OR need = 2)",
        "o99_skip_lists": f"WITH {PLAN} SELECT media_id, string_agg(category, ',' ORDER BY category) AS skip FROM need WHERE known AND need < 2 GROUP BY media_id",
        "o65_interval": f"WITH {STORED} SELECT media_id, category, (media_id % 10)::DOUBLE AS \"start\", frame_interval FROM stored",
        "o63_tag_info": f"WITH {TOTALS} SELECT DISTINCT media_id, category, display AS video_tag FROM tot WHERE required_duration > 0 AND total >= required_duration",
        "o114_pipeline": f"WITH {WANTED} SELECT {FLAT} FROM wanted",
        "o03_member_name": "SELECT page_id, ltrim(replace('//' || replace(url, '/', chr(92)), chr(92), '/'), '/') AS member FROM pages",
        "o14_backend": (
            "WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'gpu' WHEN 2 THEN 'frame' ELSE 'auto' END AS w FROM part) "
            "SELECT p_partkey, w AS with_gpu, CASE WHEN w = 'frame' THEN w ELSE 'cpu' END AS without FROM x"
        ),
        "o99_plan": f"WITH {PLAN} SELECT media_id, bool_or(NOT known OR need = 2) AS work, count(*) FILTER (WHERE NOT (NOT known OR need = 2)) AS skipped FROM need GROUP BY media_id",
        "o101_upsert": (
            f"WITH {PLAN} SELECT media_id, category, CASE WHEN NOT known OR need > 0 THEN 'new' ELSE 'old' END AS tag, (media_id % 10)::DOUBLE AS \"start\", (media_id % 10 + 4)::DOUBLE AS \"end\" FROM need"
        ),
        "o101_store": (
            f"WITH {PLAN} SELECT n.media_id, n.category, CASE WHEN NOT known OR need > 0 THEN 'new' ELSE 'old' END AS tag, (n.media_id % 10)::DOUBLE AS \"start\", (n.media_id % 10 + 4)::DOUBLE AS \"end\", "
            "CASE WHEN NOT known OR need > 0 THEN 201 ELSE s.ai_model_id END AS stored_model FROM need n LEFT JOIN stored s ON s.media_id = n.media_id AND s.category = n.category"
        ),
        "o43_all_models": f"WITH {HEADS} SELECT media_id, category, tag, frame_index, round_even(score, 2)::DOUBLE AS confidence, model FROM scored WHERE score > 0.55::DOUBLE AND t < 7",
        "o80_run_metrics": (
            f"WITH {HEADS} SELECT (SELECT count(*) FROM embeddings) AS frames, 3::INTEGER AS models, model, count(*) AS tags FROM scored WHERE score > 0.55::DOUBLE AND t < 7 GROUP BY model"
        ),
        "o73_complete": (
            "WITH o AS (SELECT DISTINCT user_id AS media_id, floor((floor(epoch(ts)) - 1704067200) / 86400)::BIGINT AS frame, event_type AS model FROM events), "
            "m AS (SELECT DISTINCT user_id AS media_id, (1 + user_id % 5)::BIGINT AS frames, CASE WHEN user_id % 2 = 0 THEN ['view'] ELSE ['view', 'click'] END AS models FROM events), "
            "f AS (SELECT media_id, unnest(range(frames)) AS frame, models FROM m), want AS (SELECT media_id, frame, unnest(models) AS model FROM f) "
            "SELECT w.media_id, count(*) AS expected, count(o.frame) AS received, count(*) - count(o.frame) AS missing, min(CASE WHEN o.frame IS NULL THEN w.frame END) AS first_gap, "
            "count(*) = count(o.frame) AS complete FROM want w LEFT JOIN o ON o.media_id = w.media_id AND o.frame = w.frame AND o.model = w.model GROUP BY w.media_id"
        ),
        "o18_documents": (
            f"WITH {runs(2, 4.0, False)} SELECT media_id, 'v3' AS was, 'v1' AS kind, '{{\"of\":[1,2]}}' AS label, count(*) AS spans, sum(\"start\") AS starts, "
            "'system' AS category, 6.0::DOUBLE AS frame_interval, 'm' AS file_name FROM spans GROUP BY media_id"
        ),
        "o50_upgrade": (
            "SELECT c_custkey AS media_id, 'engagement' AS category, 'view' AS tag, 0.0::DOUBLE AS \"start\", (c_custkey % 9)::DOUBLE AS \"end\", 0.5::DOUBLE AS confidence FROM customer "
            "UNION ALL SELECT c_custkey, 'engagement', 'view', (c_custkey % 5 + 20)::DOUBLE, NULL, 0.75::DOUBLE FROM customer UNION ALL SELECT c_custkey, 'Unknown', 'x' || (c_custkey % 2), (c_custkey % 5 + 20)::DOUBLE, NULL, 0.75::DOUBLE FROM customer"
        ),
        "o50_upgrade_models": (
            f"WITH {V0}, m AS (SELECT media_id, 'actions' AS category, CASE WHEN was = 2 THEN 2.0 ELSE 0.1 END::DOUBLE AS version, CASE WHEN was = 2 THEN 200 ELSE 950 END AS ai_model_id, CASE WHEN was = 2 THEN 'new_one' END AS file_name FROM k WHERE name = 'old_one' "
            "UNION ALL SELECT media_id, 'parts', 0.5, 200, 'new_two' FROM k WHERE name = 'old_two' UNION ALL SELECT media_id, 'actions', 2.0, 200, 'new_one' FROM k WHERE name = 'old_two') "
            "SELECT media_id, category, 2.0::DOUBLE AS frame_interval, 0.3::DOUBLE AS threshold, version, ai_model_id, file_name FROM m"
        ),
        "o18_dispatch": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v3' WHEN 2 THEN CASE WHEN props IS NULL THEN 'none' ELSE 'v0' END ELSE 'none' END AS kind FROM events",
        "o100_build_v1": f"WITH {runs()} SELECT {FLAT}, round(confidence, 6) AS confidence FROM spans",
        "o102_build_v3": f"WITH {runs(2, 4.0, False)} SELECT {FLAT} FROM spans",
        "o81_apportion": (
            "WITH x AS (SELECT l_orderkey % 500 AS batch, l_suppkey AS root, count(*) AS items FROM lineitem GROUP BY ALL) "
            "SELECT batch, root, round((batch + 1) * 0.25::DOUBLE * items / sum(items) OVER (PARTITION BY batch), 6) AS seconds FROM x"
        ),
        "o82_metrics": (
            "WITH x AS (SELECT o_custkey AS request, CASE WHEN o_orderkey % 9 = 0 THEN 'gpu' ELSE 'cpu' END AS backend, o_totalprice / 3141593.0::DOUBLE AS p, o_totalprice / 713467.0::DOUBLE AS i, o_orderkey % 50 AS f FROM orders) "
            "SELECT request, round(sum(p), 6) AS preprocess_s, round(sum(i), 6) AS inference_s, sum(f)::BIGINT AS frames, round(CASE WHEN sum(f) > 0 THEN sum(p) / sum(f) END, 6) AS s_per_frame, "
            "round(sum(p + i), 6) AS total_s, round(CASE WHEN sum(p + i) > 0 AND sum(f) > 0 THEN sum(f) / sum(p + i) END, 6) AS frames_per_s, CASE WHEN count(DISTINCT backend) = 1 THEN min(backend) ELSE 'mixed' END AS backend FROM x GROUP BY request"
        ),
        "o84_health": f"WITH {NATIONS} SELECT pipeline, count(*) AS models FROM models GROUP BY pipeline UNION ALL SELECT 'total', count(*) FROM models",
        "o85_overlap_check": "SELECT s_nationkey AS media_id, 'c' || (s_suppkey % 20) AS category, count(*) AS models FROM supplier GROUP BY ALL HAVING count(*) > 1",
        "o86_uniform": f"WITH {NATIONS} SELECT pipeline, count(DISTINCT image_size) <= 1 AND count(DISTINCT norm) <= 1 AS uniform FROM models GROUP BY pipeline",
        "o92_model_order": f"WITH {NATIONS} SELECT categories[1] AS first_category, identifier, name FROM models ORDER BY 1, 2, 3",
        "o94_union": f"WITH {det()} SELECT media_id, tag FROM det WHERE confidence >= 0.5 UNION SELECT media_id, tag FROM det WHERE frame_index < 100",
        "o95_available": "SELECT n_name AS name FROM nation WHERE n_nationkey % 3 <> 0",
        "o96_compatible": (
            f"WITH {NATIONS}, act AS (SELECT * FROM models WHERE identifier IN (2, 5)) SELECT name, image_size FROM models m WHERE image_size IN (SELECT image_size FROM act) "
            "AND NOT EXISTS (SELECT 1 FROM act WHERE list_has_any(act.categories, m.categories))"
        ),
    }
    q["o53_cluster_windowed"] = q["o53_cluster_segmented"] = q["o53_cluster"]
    q["o57_overlap_stretches"], q["o54_merge_prop_streamed"] = q["o57_overlap"], q["o54_merge_prop"]
    counted = "SELECT {k}, count(*) AS markers, '{m}' AS method FROM ({sql}) GROUP BY ALL"
    ruled = BUCKETS[BUCKETS.index("b1 AS") :].replace("FROM b0", "FROM ruled")
    q["cluster"] = f"WITH {runs()}, {RULES}, {RULED}, {ruled}, {passes(K, *DEFAULTS)} SELECT {K} FROM p10 JOIN (SELECT DISTINCT {K}, min_marker_duration AS least FROM ruled) USING ({K}) WHERE e - s + 6.0::DOUBLE >= least"
    q["o62_methods"] = " UNION ALL ".join(counted.format(k=K, m=m, sql=q[n]) for m, n in (("gap", "o52_merge_gap"), ("proportional", "o54_merge_prop"), ("cluster", "cluster")))
    del q["cluster"]
    q["o50_upgrade_document"], q["o50_document_models"] = q["o50_upgrade"], q["o50_upgrade_models"]
    return q
