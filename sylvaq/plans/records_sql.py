"""SQL counterparts of the record queries."""

from __future__ import annotations

_CARBON = "tree_carbon_updated7_spatial"

_SPLIT = f"""
tok AS (
  SELECT row_id, unnest(regexp_extract_all(soil, '[ ]*("([^"]|"")*"|''([^'']|'''')*'')[ ]*|[^,;|/\\t\\n\\r]+')) AS raw,
         generate_subscripts(regexp_extract_all(soil, '[ ]*("([^"]|"")*"|''([^'']|'''')*'')[ ]*|[^,;|/\\t\\n\\r]+'), 1) AS i
  FROM {_CARBON}
), val AS (
  SELECT row_id, i, trim(raw) AS t FROM tok WHERE trim(raw) <> ''
), clean AS (
  SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY i) AS INTEGER) AS pos, count(*) OVER (PARTITION BY row_id) AS n,
         CASE WHEN t[1] = '"' THEN replace(t[2:-2], '""', '"') WHEN t[1] = '''' THEN replace(t[2:-2], '''''', '''') ELSE t END AS soil_value
  FROM val
)"""

LOCATED = """
pts AS (
  SELECT tree_id AS id, min(X) AS x, min(Y) AS y FROM cluster_analysis_data
  WHERE tree_id IS NOT NULL AND X BETWEEN 300000 AND 900000 AND Y BETWEEN 6500000 AND 7200000 GROUP BY tree_id
), cell AS (
  SELECT *, CAST(floor(x / 25) AS BIGINT) AS cx, CAST(floor(y / 25) AS BIGINT) AS cy FROM pts
), nine AS (SELECT cell.*, cx + dx AS nx, cy + dy AS ny FROM cell, range(-1, 2) a(dx), range(-1, 2) b(dy)
), near AS (
  SELECT p.id AS a, q.id AS b FROM nine p JOIN cell q ON p.nx = q.cx AND p.ny = q.cy
  WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 625
)"""

_READ = """
long AS (
  SELECT tree_id AS item, strip_id AS source, seq_no AS ord, f.field AS field,
         CASE f.field WHEN 'H15' THEN H15 WHEN 'H17' THEN H17 WHEN 'H21' THEN H21 ELSE H23 END AS v
  FROM tree, (VALUES ('H15'), ('H17'), ('H21'), ('H23')) f(field) WHERE tree_id IS NOT NULL
), r AS (SELECT DISTINCT item, source, ord, field, v FROM long WHERE v IS NOT NULL AND NOT isnan(v) AND v <> 0)"""

_FLAG = f"""{_READ}, med AS (SELECT source, field, median(v) AS med FROM r GROUP BY source, field
), d AS (SELECT r.*, med, CASE WHEN v = med THEN 0.0 ELSE abs(v - med) END AS dist FROM r JOIN med ON r.source IS NOT DISTINCT FROM med.source AND r.field = med.field
), mad AS (SELECT source, field, median(dist) AS mad FROM d GROUP BY source, field
), seq AS (
  SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY source, field, v ORDER BY ord, item) AS isle FROM r WINDOW w AS (PARTITION BY source, field ORDER BY ord, item)
), stuck AS (SELECT item, field, count(*) OVER (PARTITION BY source, field, v, isle) AS n FROM seq
), flagged AS (
  SELECT item, field, 'bounds' AS reason FROM r WHERE v < 0 OR v > 60
  UNION ALL SELECT item, d.field, 'spike' FROM d JOIN mad ON d.source IS NOT DISTINCT FROM mad.source AND d.field = mad.field WHERE dist > 9 * mad
  UNION ALL SELECT item, field, 'stuck' FROM stuck WHERE n >= 8
)"""

_CELLS = f"""
cells AS (
  SELECT load_id, c.column_name AS column_name, c.lo AS lo, c.hi AS hi, CASE c.column_name WHEN 'lightemiss' THEN lightemiss WHEN 'ra15_17' THEN ra15_17 WHEN 'LST_1516' THEN LST_1516 END AS t,
         CASE WHEN c.column_name = 'Mono_Rate' AND NOT isnan(Mono_Rate) THEN Mono_Rate END AS m
  FROM {_CARBON}, (VALUES ('lightemiss', 0, 500), ('ra15_17', 0, 9000), ('LST_1516', -10, 60), ('Mono_Rate', 0, 1)) c(column_name, lo, hi)
), num AS (
  SELECT load_id, column_name, t, (m IS NULL AND (t IS NULL OR regexp_full_match(t, ' *'))) AS gone, lo, hi,
         CASE WHEN column_name = 'Mono_Rate' THEN m WHEN regexp_full_match(t, '-?[0-9]+(\\.[0-9]+)?') THEN CAST(t AS DOUBLE) END AS v
  FROM cells
), kept AS (SELECT *, CASE WHEN v BETWEEN lo AND hi THEN v END AS inside FROM num
), top AS (SELECT load_id, column_name, inside, count(*) AS k FROM kept WHERE inside IS NOT NULL GROUP BY ALL
), tops AS (SELECT load_id, column_name, max(k) AS top_count, arg_min(inside, (-k, inside)) AS top_value FROM top GROUP BY ALL
), prof AS (
  SELECT load_id, column_name, count(*) AS rows, count(*) FILTER (gone) AS missing, count(*) FILTER (NOT gone AND v IS NULL) AS malformed, count(v) AS numbers,
         count(v) - count(inside) AS out_of_bounds, count(DISTINCT v) AS distinct_values, min(v) AS min_value, max(v) AS max_value,
         quantile_cont(inside, 0.25) AS q1, quantile_cont(inside, 0.5) AS median, quantile_cont(inside, 0.75) AS q3
  FROM kept GROUP BY ALL
), profile AS (SELECT prof.*, coalesce(top_count, 0) AS top_count, top_value FROM prof LEFT JOIN tops USING (load_id, column_name))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"WITH {_SPLIT} SELECT row_id, pos, soil_value FROM clean WHERE n >= 2",
        "p2_value_counts": f"WITH {_SPLIT} SELECT soil_value, count(*) AS n, CAST(max(pos) AS BIGINT) AS last_pos FROM clean GROUP BY soil_value",
        "p3_found": f"WITH {LOCATED} SELECT a AS tree_id_a, b AS tree_id_b FROM near WHERE a < b",
        "p3_density25": f"WITH {LOCATED} SELECT a AS tree_id, count(*) - 1 AS density25 FROM near GROUP BY a",
        "p5_found": f"WITH {_FLAG} SELECT DISTINCT item AS tree_id, field FROM flagged",
        "p5_reasons": f"WITH {_FLAG} SELECT field, reason, count(*) AS n FROM flagged GROUP BY field, reason",
        "p5_rolling": f"""WITH {_READ}, w AS (
  SELECT *, list(v) OVER (PARTITION BY source, field ORDER BY ord, item ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS near FROM r
), m AS (SELECT *, list_median(near) AS med FROM w
), d AS (SELECT *, list_median(list_transform(near, lambda x: CASE WHEN x = med THEN 0.0 ELSE abs(x - med) END)) AS mad, CASE WHEN v = med THEN 0.0 ELSE abs(v - med) END AS gap FROM m)
SELECT item AS tree_id, field, round(med, 6) AS med, round(mad, 6) AS mad FROM d WHERE gap > 9 * mad""",
        "p6_found": f"""WITH {_CELLS}, u AS (
  SELECT load_id, column_name, missing / rows AS m, malformed / nullif(rows - missing, 0) AS p, out_of_bounds / nullif(numbers, 0) AS r,
         top_count / nullif(numbers - out_of_bounds, 0) AS k, median, q3 - q1 AS spread FROM profile
), usual AS (SELECT column_name, median(m) AS um, median(p) AS up, median(r) AS ur, median(median) AS umed, median(spread) AS us FROM u GROUP BY column_name)
SELECT load_id, column_name, unnest(list_filter([CASE WHEN m - um >= 0.15 THEN 'missing' END, CASE WHEN p - up >= 0.05 THEN 'pattern' END, CASE WHEN r - ur >= 0.05 THEN 'range' END,
  CASE WHEN abs(median - umed) > 0.5 * us THEN 'shift' END, CASE WHEN k >= 0.4 THEN 'constant' END], lambda x: x IS NOT NULL)) AS finding FROM u JOIN usual USING (column_name)""",
        "p6_profile": f"""WITH {_CELLS} SELECT load_id, column_name, rows, missing, malformed, numbers, out_of_bounds, distinct_values, round(min_value, 6) AS min_value, round(max_value, 6) AS max_value,
  round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(top_value, 6) AS top_value, top_count, coalesce(malformed_distinct, 0) AS malformed_distinct, coalesce(top_malformed_count, 0) AS top_malformed_count, top_malformed FROM profile LEFT JOIN (
  SELECT load_id, column_name, count(*) AS malformed_distinct, arg_min(t, (-k, t)) AS top_malformed, max(k) AS top_malformed_count FROM (SELECT load_id, column_name, t, count(*) AS k FROM kept WHERE NOT gone AND v IS NULL GROUP BY ALL) GROUP BY ALL
) USING (load_id, column_name)""",
        "p6_drift": f"""WITH {_CELLS}, base AS (SELECT DISTINCT column_name, load_id FROM kept WHERE inside IS NOT NULL
), side AS (SELECT b.column_name, b.load_id, inside AS v, CAST(k.load_id = b.load_id AS INTEGER) AS a FROM kept k JOIN base b ON k.column_name = b.column_name WHERE inside IS NOT NULL
), curve AS (
  SELECT column_name, load_id, sum(a) OVER w AS ca, sum(1 - a) OVER w AS cb, sum(a) OVER g AS na, sum(1 - a) OVER g AS nb FROM side
  WINDOW w AS (PARTITION BY column_name, load_id ORDER BY v), g AS (PARTITION BY column_name, load_id))
SELECT column_name, load_id, CAST(max(na) AS BIGINT) AS n, CAST(max(nb) AS BIGINT) AS n_others, round(max(abs(ca / na - cb / nb)), 6) AS ks FROM curve GROUP BY ALL""",
        "p6_distance": f"""WITH {_CELLS}, base AS (SELECT DISTINCT column_name, load_id FROM kept WHERE inside IS NOT NULL
), pair AS (SELECT column_name, load_id AS load_a, lead(load_id) OVER (PARTITION BY column_name ORDER BY load_id) AS load_b FROM base
), side AS (
  SELECT p.column_name, load_a, load_b, inside AS v, 1 AS a, 0 AS b FROM kept k JOIN pair p ON k.column_name = p.column_name AND k.load_id = load_a WHERE inside IS NOT NULL AND load_b IS NOT NULL
  UNION ALL SELECT p.column_name, load_a, load_b, inside, 0, 1 FROM kept k JOIN pair p ON k.column_name = p.column_name AND k.load_id = load_b WHERE inside IS NOT NULL
), curve AS (
  SELECT column_name, load_a, load_b, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER g AS na, sum(b) OVER g AS nb FROM side
  WINDOW w AS (PARTITION BY column_name, load_a, load_b ORDER BY v), g AS (PARTITION BY column_name, load_a, load_b))
SELECT column_name, load_a, load_b, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b, round(max(abs(ca / na - cb / nb)), 6) AS ks FROM curve GROUP BY ALL""",
    }
