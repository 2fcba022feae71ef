"""The derived scene in SQL, as common table expressions for the oracles."""

OBSTACLES = """
obstacles AS (
  SELECT CAST(p // 200 AS INTEGER) AS scene_id, 'scene_' || (p // 200) AS source_file, concat_ws('-', p, q) AS object_id, 'box ' || p AS name,
    CASE WHEN p % 11 = 0 THEN NULL WHEN p % 13 = 0 THEN '' WHEN q % 3 = 0 THEN ' OST_Floors ' WHEN q % 3 = 1 THEN 'OST_StructuralFraming' ELSE 'OST_GenericModel' END AS ost_type,
    CASE WHEN p % 2 = 0 THEN 'beam_structure ' ELSE 'COLUMN' END AS ddworks_type,
    CAST(p % 64 * 100 + sh AS DOUBLE) AS min_x, CAST((p * 7 + p // 64 * 17) % 64 * 100 + sh AS DOUBLE) AS min_y, CAST(p // 8 % 16 * 100 + sh AS DOUBLE) AS min_z,
    CAST(p % 64 * 100 + sh + e AS DOUBLE) AS max_x, CAST((p * 7 + p // 64 * 17) % 64 * 100 + sh + e AS DOUBLE) AS max_y,
    CAST(p // 8 % 16 * 100 + sh + CASE WHEN p % 37 = 0 THEN 0 ELSE e END AS DOUBLE) AS max_z
  FROM (SELECT p_partkey AS p, p_size AS q, CASE WHEN p_size % 2 = 1 THEN 50 ELSE 0 END AS sh, (1 + p_size % 4) * 100 AS e FROM part))"""

VALID = "max_x > min_x AND max_y > min_y AND max_z > min_z"

CELLS = f"""
boxes AS (
  SELECT *, CAST(greatest(floor(min_x / 100), 0) AS INTEGER) AS i0, CAST(least(ceil(max_x / 100), 64) AS INTEGER) AS i1,
    CAST(greatest(floor(min_y / 100), 0) AS INTEGER) AS j0, CAST(least(ceil(max_y / 100), 64) AS INTEGER) AS j1,
    CAST(greatest(floor(min_z / 100), 0) AS INTEGER) AS k0, CAST(least(ceil(max_z / 100), 16) AS INTEGER) AS k1
  FROM obstacles WHERE {VALID}),
box_cells AS (
  SELECT scene_id, object_id, ost_type, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(unnest(range(k0, k1)) AS INTEGER) AS k
  FROM (SELECT *, unnest(range(j0, j1)) AS j FROM (SELECT *, unnest(range(i0, i1)) AS i FROM boxes))),
cells AS (SELECT DISTINCT scene_id, i, j, k FROM box_cells)"""

TASKS = """
tasks AS (
  SELECT *, si * 100.0::DOUBLE + 50 AS sx, sj * 100.0::DOUBLE + 50 AS sy, sk * 100.0::DOUBLE + 50 AS sz,
    gi * 100.0::DOUBLE + 50 AS gx, gj * 100.0::DOUBLE + 50 AS gy, gk * 100.0::DOUBLE + 50 AS gz,
    '[' || coalesce(nullif(utility_group, ''), '?') || '] ' || coalesce(nullif(utility, ''), '?') AS label,
    CAST(CASE size_text WHEN '40A' THEN 40 WHEN '1/2B' THEN 12.7 WHEN '1-1/4B' THEN 31.75 WHEN '65' THEN 65 WHEN '1/4BX1/2B' THEN 6.35 ELSE 0 END AS DOUBLE) AS diameter_mm
  FROM (SELECT c_custkey AS task_id, CAST(c_custkey // 150 AS INTEGER) AS scene_id, 0 AS si, CAST(c_custkey % 64 AS INTEGER) AS sj, CAST(c_custkey % 16 AS INTEGER) AS sk,
      63 AS gi, CAST((c_custkey * 3 + c_custkey // 5) % 64 AS INTEGER) AS gj, CAST(c_custkey // 7 % 16 AS INTEGER) AS gk,
      CASE WHEN c_custkey % 17 <> 0 THEN ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][CAST(c_custkey % 5 AS INTEGER) + 1] END AS utility, ['F', 'O', 'P'][CAST(c_custkey % 3 AS INTEGER) + 1] AS utility_group,
      ['40A', '1/2B', '1-1/4B', '65', '1/4BX1/2B', NULL][CAST(c_custkey % 6 AS INTEGER) + 1] AS size_text, abs(c_acctbal) * 30 + 10 AS price
    FROM customer))"""

PATHS = """
paths AS (
  SELECT task_id, scene_id, CAST(pos AS INTEGER) AS pos, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k FROM (
    SELECT task_id, scene_id, n AS pos, n AS i, sj AS j, sk AS k FROM tasks, range(0, 64) x(n)
    UNION ALL SELECT task_id, scene_id, 63 + n, 63, sj + n * sign(gj - sj), sk FROM tasks, range(1, 64) x(n) WHERE n <= abs(gj - sj)
    UNION ALL SELECT task_id, scene_id, 63 + abs(gj - sj) + n, 63, gj, sk + n * sign(gk - sk) FROM tasks, range(1, 16) x(n) WHERE n <= abs(gk - sk)))"""

DETAILS = """
details AS (
  SELECT DISTINCT l_orderkey AS route_guid, l_linenumber AS order_1, l_partkey * 100000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS order_2,
    CAST(l_partkey % 8 * 100 AS DOUBLE) AS from_x, CAST(l_suppkey % 8 * 100 AS DOUBLE) AS from_y, CAST(l_linenumber * 100 AS DOUBLE) AS from_z,
    CAST((l_partkey + l_linenumber % 2) % 8 * 100 AS DOUBLE) AS to_x, CAST(l_suppkey % 8 * 100 AS DOUBLE) AS to_y, CAST(l_linenumber * 100 AS DOUBLE) AS to_z
  FROM lineitem),
points AS (
  SELECT route_guid, row_number() OVER (PARTITION BY route_guid ORDER BY order_1, order_2, e) AS n, x, y, z FROM (
    SELECT route_guid, order_1, order_2, 0 AS e, from_x AS x, from_y AS y, from_z AS z FROM details
    UNION ALL SELECT route_guid, order_1, order_2, 1, to_x, to_y, to_z FROM details)),
vertices AS (
  SELECT route_guid, CAST(row_number() OVER (PARTITION BY route_guid ORDER BY n) - 1 AS INTEGER) AS pos, x, y, z
  FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM points WINDOW w AS (PARTITION BY route_guid ORDER BY n))
  WHERE px IS NULL OR x <> px OR y <> py OR z <> pz)"""


def having(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"
