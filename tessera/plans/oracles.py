"""DuckDB SQL of the queries' rows, written apart from the queries."""

from __future__ import annotations

from tessera.plans.bindings import RECORDS

ORACLES: dict[str, str] = {}

#: Levels of the trees, as of the production rules.
DEPTH = 20


def n(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


ITEMS = f"""base AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS id,
    l_extendedprice / {n(1000.0)} AS cx, CAST(l_quantity AS DOUBLE) AS cy,
    CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) / {n(50.0)} AS cz,
    CAST(p_size AS DOUBLE) * {n(0.01)} AS hx, CAST(p_size AS DOUBLE) * {n(0.02)} AS hy, CAST(p_size AS DOUBLE) * {n(0.005)} AS hz,
    CAST(p_size AS BIGINT) * 24 AS triangles, p_partkey AS part
  FROM lineitem JOIN part ON l_partkey = p_partkey
), items AS (
  SELECT id, triangles, part, cx - hx AS xmin, cy - hy AS ymin, cz - hz AS zmin, cx + hx AS xmax, cy + hy AS ymax, cz + hz AS zmax FROM base
), mid AS (
  SELECT *, {", ".join(f"({a}min + {a}max) * {n(0.5)} AS m{a}" for a in "xyz")} FROM items
), root AS (
  SELECT {", ".join(f"min({a}min) AS r{a}min, max({a}max) AS r{a}max" for a in "xyz")} FROM items
), rooted AS (
  SELECT *, {", ".join(f"(r{a}min + r{a}max) * {n(0.5)} AS rc{a}, r{a}max - r{a}min AS rs{a}" for a in "xyz")} FROM mid, root
)"""


def q(name: str, body: str, before: str = ITEMS) -> None:
    ORACLES[name] = f"WITH {before}\n{body}" if before else body


DIAG = "sqrt((xmax - xmin) * (xmax - xmin) + (ymax - ymin) * (ymax - ymin) + (zmax - zmin) * (zmax - zmin))"
q("aabb_metrics", f"SELECT id, round({DIAG}, 6) AS diagonal, round(greatest(xmax - xmin, ymax - ymin, zmax - zmin), 6) AS max_side, round(mx, 6) AS cx, round(my, 6) AS cy, round(mz, 6) AS cz FROM mid")
_HALF = [f"(({a}max - {a}min) * {n(0.5)})" for a in "xyz"]
q("tiles_box", f"SELECT id, round(mx, 6) AS b0, round(-mz, 6) AS b1, round(my, 6) AS b2, round({_HALF[0]}, 6) AS b3, round({_HALF[1]}, 6) AS b8, round(-{_HALF[2]}, 6) AS b10, round(sqrt({' + '.join(f'{h} * {h}' for h in _HALF)}), 6) AS radius FROM mid")
q("scene_bounds", "SELECT min(xmin) AS xmin, min(ymin) AS ymin, min(zmin) AS zmin, max(xmax) AS xmax, max(ymax) AS ymax, max(zmax) AS zmax, count(*) AS n_boxes FROM items")
_OCTANT = " + ".join(f"CASE WHEN m{a} >= rc{a} THEN {1 << i} ELSE 0 END" for i, a in enumerate("xyz"))
q("octant_of_center", f"SELECT CAST({_OCTANT} AS INTEGER) AS octant, count(*) AS n, CAST(sum(triangles) AS BIGINT) AS triangles FROM rooted GROUP BY 1")
# all eight loose boxes, tested one by one
_BOXES = " UNION ALL ".join(
    "SELECT id, {k} AS child, ".format(k=k) + " AND ".join(f"{a}min >= rc{a} {'+' if k >> i & 1 else '-'} rs{a} * {n(0.25)} - rs{a} * {n(0.25)} * {n(1.8)} AND {a}max <= rc{a} {'+' if k >> i & 1 else '-'} rs{a} * {n(0.25)} + rs{a} * {n(0.25)} * {n(1.8)}" for i, a in enumerate("xyz")) + " AS inside FROM rooted"
    for k in range(8)
)
q("containing_child", f"""SELECT CAST(child AS INTEGER) AS child, count(*) AS n, count(*) FILTER (WHERE child = octant) AS same_as_center FROM (
  SELECT b.id, CASE WHEN count(*) FILTER (WHERE inside) = 1 THEN max(child) FILTER (WHERE inside) ELSE -1 END AS child, any_value({_OCTANT}) AS octant
  FROM ({_BOXES}) b JOIN rooted USING (id) GROUP BY b.id) GROUP BY 1""")


def paths(depth: int) -> str:
    """One CTE per level: the distance from the node's centre on each axis."""
    out = [f"p0 AS (SELECT id, triangles, {', '.join(f'm{a} - rc{a} AS d{a}, rs{a}' for a in 'xyz')}, '' AS path FROM rooted)"]
    for k in range(depth):
        step = 0.25 * (1.8 / 2) ** k
        digit = " + ".join(f"CASE WHEN d{a} >= 0 THEN {1 << i} ELSE 0 END" for i, a in enumerate("xyz"))
        moved = ", ".join(f"CASE WHEN d{a} >= 0 THEN d{a} - rs{a} * {n(step)} ELSE d{a} + rs{a} * {n(step)} END AS d{a}, rs{a}" for a in "xyz")
        out.append(f"p{k + 1} AS MATERIALIZED (SELECT id, triangles, {moved}, path || CAST({digit} AS VARCHAR) AS path FROM p{k})")
    return ", ".join(out)


q("octree_paths", "SELECT id, path FROM p6", f"{ITEMS}, {paths(6)}")


def tree(depth: int) -> str:
    """Nodes top-down, level by level: a node's children exist iff it is divided."""
    side = "(SELECT greatest(rxmax - rxmin, rymax - rymin, rzmax - rzmin) FROM root)"
    out = [f"{ITEMS}, {paths(depth)}"]
    for k in range(depth + 1):
        only = f"WHERE left(path, {k - 1}) IN (SELECT path FROM n{k - 1} WHERE NOT is_leaf)" if k else ""
        small = f"{side} * pow({n(0.9)}, {k}) <= {n(1e-6)}"
        out.append(
            f"n{k} AS MATERIALIZED (SELECT left(path, {k}) AS path, {k} AS depth, count(*) AS n_items, CAST(sum(triangles) AS BIGINT) AS tri_sum, min(id) AS first_id, "
            f"({k} >= {depth} OR count(*) <= 96 OR sum(triangles) <= 30000 OR {small}) AS is_leaf FROM p{depth} {only} GROUP BY 1)"
        )
    out.append("nodes AS (" + " UNION ALL ".join(f"SELECT * FROM n{k}" for k in range(depth + 1)) + ")")
    out.append(f"members AS (SELECT n.path, p.id AS item_id FROM p{depth} p JOIN nodes n ON n.is_leaf AND left(p.path, n.depth) = n.path)")
    return ", ".join(out)


TREE = tree(DEPTH)
q("octree_leaves", "SELECT path, CAST(depth AS INTEGER) AS depth, n_items, tri_sum, is_leaf FROM nodes", TREE)
q("octree_leaf_summary", "SELECT path, n_items, tri_sum, first_id FROM nodes WHERE is_leaf", TREE)
q("tile_ids_postorder", "SELECT path, row_number() OVER (ORDER BY path || '8') - 1 AS tile_id FROM nodes", TREE)
q("tile_depth", "SELECT CAST(max(depth) + 1 AS BIGINT) AS levels FROM nodes", TREE)
q("octree_membership", "SELECT path, item_id FROM members", TREE)
q("subtree_items", "SELECT count(*) AS n_items, count(DISTINCT path) AS n_leaves FROM members WHERE path LIKE '0%'", TREE)

# a node's sides shrink by 0.9 per level, so its diagonal does
_K = f"""{TREE}, shape AS (
  SELECT nodes.*, (SELECT max(depth) + 1 FROM nodes) AS levels,
    sqrt((rxmax - rxmin) * (rxmax - rxmin) + (rymax - rymin) * (rymax - rymin) + (rzmax - rzmin) * (rzmax - rzmin)) AS rootd
  FROM nodes, root
), sized AS (SELECT *, rootd * pow({n(0.9)}, depth) AS diag FROM shape
), rel AS (SELECT *, least({n(1.0)}, diag / greatest({n(1e-9)}, rootd)) AS rel, least({n(1.0)}, CAST(depth AS DOUBLE) / CAST(greatest(levels, 1) AS DOUBLE)) AS dn, diag * {n(0.25)} AS err FROM sized
), tuned AS (SELECT *, least({n(1.0)}, ({n(1.0)} - rel) * {n(0.65)} + dn * {n(0.35)}) AS eager FROM rel
), settings AS (SELECT path, is_leaf, depth, rel AS relative_size, dn AS normalized_depth, rel * {n(0.75)} + ({n(1.0)} - dn) * {n(0.25)} AS importance,
    diag * {n(8e-4)} AS position_step, greatest({n(3e-5)}, least({n(2e-2)}, diag / rootd * {n(1.5e-3)})) AS normal_step,
    greatest({n(1e-9)}, least({n(1e-3)}, diag / rootd * {n(5e-6)})) AS texcoord_step,
    {n(0.42)} + {n(0.26)} * ({n(1.0)} - eager) AS simplify_ratio,
    greatest({n(0.0075)}, least({n(0.1)}, {n(5.0)} * greatest({n(0.0015)}, err / rootd * {n(0.4)}) * ({n(0.85)} + {n(0.3)} * dn))) AS simplify_error, err AS own_error FROM tuned)"""
_T = ["relative_size", "normalized_depth", "importance", "position_step", "normal_step", "simplify_ratio", "simplify_error", "own_error"]
q("node_tuning", f"SELECT path, {', '.join(f'round({c}, 9) AS {c}' for c in _T)} FROM settings", _K)
q("geometric_error_tree", "SELECT path, round(CASE WHEN is_leaf THEN 0 ELSE own_error END, 6) AS tile_error FROM settings", _K)
q("aggression_low", f"SELECT path, round(position_step * {n(1.8)}, 9) AS position_step, round(normal_step * {n(1.8)}, 9) AS normal_step, round(texcoord_step * {n(1.8)}, 9) AS texcoord_step, round(simplify_error * {n(1.8)}, 9) AS simplify_error, round(greatest({n(0.01)}, simplify_ratio - ({n(1.0)} - simplify_ratio) * {n(0.8)}), 9) AS simplify_ratio FROM settings", _K)
q("leaf_size_cull", f"SELECT m.path, count(*) AS kept FROM members m JOIN items i ON i.id = m.item_id JOIN sized s ON s.path = m.path WHERE {DIAG} / s.diag >= {n(0.02)} GROUP BY m.path", _K)
q("tile_metadata", """SELECT tile_id, '{"label":["item ' || first_id || '"],"tileId":["' || tile_id || '"],"tileKind":["' || CASE WHEN is_leaf THEN 'leaf' ELSE 'proxy' END || '"]}' AS batch_table
FROM (SELECT *, row_number() OVER (ORDER BY path || '8') - 1 AS tile_id FROM nodes)""", TREE)
_FAR = "[" + ", ".join(n(0.25 * (1.8 / 2) ** k) for k in range(DEPTH)) + "]"


def _middle(axis: str, bit: int) -> str:
    return f"r{axis}min * {n(0.5)} + r{axis}max * {n(0.5)} + coalesce(list_sum(list_transform(range(1, len(path) + 1), lambda k: CASE WHEN (CAST(path[k] AS INTEGER) & {bit}) <> 0 THEN 1 ELSE -1 END * (r{axis}max - r{axis}min) * {_FAR}[k])), 0)"


q("tileset_rows", f"""SELECT path, tile_id, 'tile_' || tile_id || '.b3dm' AS uri, round({_middle('x', 1)} + {n(0.00012345)}, 3) AS b1, round(-({_middle('z', 4)}) + {n(0.00012345)}, 3) AS b2, round({_middle('y', 2)} + {n(0.00012345)}, 3) AS b3,
  round((rxmax - rxmin) * pow({n(0.9)}, len(path)) * {n(0.5)} + {n(0.00012345)}, 3) AS b4, round(CASE WHEN is_leaf THEN 0 ELSE own_error END, 6) AS error
FROM (SELECT *, row_number() OVER (ORDER BY path || '8') - 1 AS tile_id FROM settings), root""", _K)
_BOTTOM = f"b{DEPTH} AS (SELECT path, depth, tri_sum AS content FROM nodes WHERE depth = {DEPTH})"
for _d in range(DEPTH - 1, -1, -1):
    _BOTTOM += f", b{_d} AS (SELECT path, depth, tri_sum AS content FROM nodes WHERE depth = {_d} AND is_leaf UNION ALL SELECT left(path, {_d}), {_d}, CAST(sum(content // 2) AS BIGINT) FROM b{_d + 1} GROUP BY 1)"
q("bottom_up_triangles", " UNION ALL ".join(f"SELECT path, content FROM b{k}" for k in range(DEPTH + 1)), f"{TREE}, {_BOTTOM}")
_FIT = f"r / sin(radians({n(60.0)}) / 2)"
q("camera_fit", f"SELECT round({_FIT} * {n(1.2)}, 6) AS distance, round(greatest({_FIT} / 1000, {n(0.01)}), 6) AS near, round({_FIT} * 20, 6) AS far, round(greatest(r * {n(0.5)}, {n(1.0)}), 6) AS speed FROM (SELECT sqrt((rxmax - rxmin) * (rxmax - rxmin) + (rymax - rymin) * (rymax - rymin) + (rzmax - rzmin) * (rzmax - rzmin)) / 2 AS r FROM root)")
q("tessellation_policies", f"""SELECT p_partkey AS occ_id, round(d * {n(2e-3)} * {n(0.5)}, 9) AS high_linear, round({n(3.0)} * {n(0.5)}, 9) AS high_angular,
  round(d * {n(0.85)} * {n(0.5)}, 9) AS low_linear, round({n(35.0)} * {n(0.5)}, 9) AS low_angular FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS d FROM part)""", "")

# -- scenes -------------------------------------------------------------------

OCC = "occ AS (SELECT p_partkey AS occ_id, p_name AS source_label, p_brand AS geometry_key, p_type AS material_key, p_brand || '|mat:' || p_type AS qualified_key, p_size % 5 = 0 AS from_explicit, CAST(p_size AS BIGINT) * 24 AS triangles, CAST(p_size AS BIGINT) AS size FROM part)"
PROTO = f"{OCC}, proto AS (SELECT qualified_key, min(occ_id) AS first_occ, count(*) AS n_occurrences, arg_min(triangles, occ_id) AS triangles, row_number() OVER (ORDER BY min(occ_id)) - 1 AS prototype_id FROM occ GROUP BY qualified_key)"
q("prototype_dedup", "SELECT prototype_id, qualified_key, first_occ, n_occurrences, triangles FROM proto", PROTO)
q("instance_table", "SELECT row_number() OVER (ORDER BY occ_id) - 1 AS instance_id, prototype_id, occ_id, from_explicit FROM occ JOIN proto USING (qualified_key)", PROTO)
q("scene_counters", "SELECT count(*) AS instances, count(DISTINCT qualified_key) AS prototypes, count(*) - count(DISTINCT qualified_key) AS dedup_hits, count(*) FILTER (WHERE from_explicit) AS explicit_references, CAST(sum(triangles) AS BIGINT) AS triangles FROM occ", OCC)
q("bake_reference_offset", "SELECT occ_id, coalesce(min(occ_id) FILTER (WHERE size % 4 = 0) OVER (PARTITION BY qualified_key), -1) AS reference_occ FROM occ", OCC)
q("prototype_uris", "SELECT prototype_id, CASE WHEN prototype_id % 3 <> 0 THEN 'instance_lods/proto_' || prototype_id || '_high.glb' ELSE '' END AS uri FROM proto", PROTO)
q("face_seed_prototypes", """SELECT row_number() OVER (ORDER BY occ_id, slot) - 1 AS prototype_id, qualified_key, occ_id, slot FROM (
  SELECT qualified_key, min(occ_id) AS occ_id, CAST(0 AS BIGINT) AS slot FROM occ GROUP BY qualified_key
  UNION ALL
  SELECT k, f.occ_id, f.face + 1 FROM (SELECT 'face|' || geometry_key || '|mat:' || material_key || ':' || face AS k, min({'occ_id': occ_id, 'face': face}) AS f
    FROM (SELECT *, unnest(range(0, size % 4 + 1)) AS face FROM occ) GROUP BY 1))""", OCC)
q("instance_triangles", "SELECT CASE WHEN prototype_id % 7 <> 0 THEN proto.triangles ELSE 0 END AS triangles, count(*) AS n FROM occ JOIN proto USING (qualified_key) GROUP BY 1", PROTO)
q("key_summary", f"SELECT qualified_key, count(*) AS n, greatest(max(CAST(size AS DOUBLE)), {n(25.0)}) AS max_diagonal FROM occ GROUP BY 1", OCC)
COLORS = f"{OCC}, col AS (SELECT occ_id, size, CASE WHEN size & 1 <> 0 THEN (size % 3) || ',0,1' END AS gen, CASE WHEN size & 2 <> 0 THEN (size % 4) || ',0,1' END AS surf, CASE WHEN size & 4 <> 0 THEN (size % 5) || ',0,1' END AS curv, size % 3 AS fe FROM occ)"
q("color_signature_topk", """SELECT 'shape(' || (gen IS NOT NULL)::INT || ',' || (surf IS NOT NULL)::INT || ',' || (curv IS NOT NULL)::INT || ')' || coalesce('|gen:' || gen, '') || coalesce('|surf:' || surf, '') || coalesce('|curv:' || curv, '') || '|faceColorEntries:' || fe AS signature, count(*) AS n
FROM col GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", COLORS)
q("color_resolution", "SELECT occ_id, coalesce(curv, surf, gen) AS color, coalesce(surf, gen) AS export FROM col", COLORS)
q("face_color_fallback", "SELECT occ_id, coalesce(surf, gen, curv) AS color FROM col", COLORS)
q("mesh_use_count", "SELECT geometry_key AS mesh, count(*) AS uses, count(*) > 1 AS explicit FROM occ GROUP BY 1", OCC)
q("explicit_reference", "SELECT occ_id, coalesce((SELECT count(*) FROM occ o WHERE o.material_key = occ.material_key AND o.size > 45) > 1, false) AS explicit FROM occ", OCC)
q("triangle_estimates", "SELECT occ_id, CASE WHEN size % 2 = 0 THEN size ELSE least(size * 100000000 * 24, 4294967295) END AS estimate FROM occ", OCC)
q("rejected_leaves", "SELECT occ_id AS leaf, greatest((SELECT count(*) FROM occ WHERE size % 3 = 0) - 20, 0) AS more FROM occ WHERE size % 3 = 0 ORDER BY 1 LIMIT 20", OCC)
q("subshape_counts", "SELECT geometry_key AS shape, count(*) FILTER (WHERE size % 3 = 0) AS faces, count(*) FILTER (WHERE size % 3 = 1) AS edges, count(*) FILTER (WHERE size % 3 = 2) AS vertices FROM occ GROUP BY 1", OCC)
q("fidelity_evidence", "SELECT count(*) AS instances, (SELECT count(DISTINCT qualified_key) FROM occ) AS prototypes, count(coalesce(gen, surf, curv)) AS colored, CAST(sum(fe) AS BIGINT) AS face_color_entries FROM col", COLORS)

# -- hierarchies: closed forms of the three levels ----------------------------------

PLACED = f"""placed AS (
  SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS path, 0 AS depth, CAST(r_regionkey AS DOUBLE) * 10 AS x, {n(0.0)} AS y, {n(0.0)} AS z, {n(1.0)} AS sy, {n(1.0)} AS sz FROM region
  UNION ALL
  SELECT 'n' || n_nationkey, 'r' || n_regionkey || '/n' || n_nationkey || '#mesh_0', 1, CAST(n_regionkey AS DOUBLE) * 10, 0, 0, 2, -1 FROM nation
  UNION ALL
  SELECT 's' || s_suppkey, 'r' || n_regionkey || '/n' || n_nationkey || '#mesh_0/s' || s_suppkey || '#mesh_' || s_suppkey % 2, 2,
    CAST(n_regionkey AS DOUBLE) * 10 + s_suppkey, 2 * CAST(s_suppkey AS DOUBLE) / 2, 0 - CAST(s_suppkey AS DOUBLE) / 4, 2, -1 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
q("assembly_flatten", "SELECT path, CAST(depth AS INTEGER) AS depth, CAST(1 AS DOUBLE) AS m1, x AS m4, sy AS m6, y AS m8, sz AS m11, z AS m12 FROM placed", PLACED)
q("node_paths", "SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n, min(path) AS first_path, max(path) AS last_path FROM placed GROUP BY 1", PLACED)
q("scene_meshes", "SELECT substr(node, 2) AS mesh, x, round(sy * sz, 6) AS det FROM placed WHERE depth = 2", PLACED)
q("first_mesh", "SELECT node AS mesh, node, path FROM placed WHERE depth = 2 ORDER BY path LIMIT 1", PLACED)
q("solid_else_shell", "SELECT geometry_key AS label, occ_id AS shape, CASE WHEN size > 47 THEN 'SOLID' ELSE 'SHELL' END AS kind FROM occ WHERE size > 47 OR geometry_key NOT IN (SELECT geometry_key FROM occ WHERE size > 47)", OCC)

# -- meshes ---------------------------------------------------------------------

VERT = "vert AS (SELECT CAST(label AS BIGINT) AS prim_id, vec_id AS vidx, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(("x", "y", "z", "nx", "ny", "nz", "u", "v"))) + " FROM embeddings)"
TRI = f"""{VERT}, k AS (SELECT count(*) AS nv FROM embeddings), tri0 AS (
  SELECT event_id % 10 AS prim_id, event_id AS tidx, event_id % nv AS a, (event_id * 7 + 3) % nv AS b0, (event_id * 13 + 5) % nv AS c0, nv FROM events, k
), tri AS (SELECT prim_id, tidx, a, CASE WHEN tidx % 10 = 0 THEN a ELSE b0 END AS b, CASE WHEN tidx % 17 = 0 THEN c0 + nv ELSE c0 END AS c, nv FROM tri0
), ok AS (SELECT * FROM tri WHERE a < nv AND b < nv AND c < nv)"""
_M = f"""{VERT}, m AS (SELECT *, CAST(u AS DOUBLE) AS sx, CAST(v AS DOUBLE) AS sy, {n(-2.0)} AS sz FROM vert)"""
q("transform_compose", "SELECT vidx, round(sx * sx + x * x, 6) AS m1, round(x * y, 6) AS m2, round(x, 6) AS m4, round(y * z, 6) AS m7, round(sz * sz + z * z, 6) AS m11, round(CAST(1 AS DOUBLE), 6) AS m16, round(sx * sx + x * x, 6) AS c1, round(sx * sy * sz, 6) AS det FROM m", _M)
_N = "sqrt((nx / sx) * (nx / sx) + (ny / sy) * (ny / sy) + (nz / sz) * (nz / sz))"
q("transform_points", f"SELECT vidx, round(sx * nx + x, 6) AS px, round(sy * ny + y, 6) AS py, round(sz * nz + z, 6) AS pz, round(nx / sx / {_N}, 4) + 0 AS nx, round(ny / sy / {_N}, 4) + 0 AS ny, round(nz / sz / {_N}, 4) + 0 AS nz, round(x - abs(sx), 6) AS xmin, round(z + 2, 6) AS zmax FROM m", _M)
q("mirror_winding", "SELECT tidx, CASE WHEN prim_id % 2 = 0 THEN c ELSE b END AS b, CASE WHEN prim_id % 2 = 0 THEN b ELSE c END AS c FROM tri", TRI)
WELD = f"weld AS (SELECT vidx, min(vidx) OVER (PARTITION BY round(x / {n(0.05)}), round(y / {n(0.05)}), round(z / {n(0.2)})) AS t FROM vert)"
q("vertex_weld", "SELECT vidx, t AS \"to\" FROM weld", f"{VERT}, {WELD}")
q("weld_remap", """SELECT prim_id, tidx, coalesce(wa.t, 0) AS a, coalesce(wb.t, 0) AS b, coalesce(wc.t, 0) AS c, CAST((wa.t IS NULL)::INT + (wb.t IS NULL)::INT + (wc.t IS NULL)::INT AS INTEGER) AS missed
FROM tri LEFT JOIN weld wa ON wa.vidx = a LEFT JOIN weld wb ON wb.vidx = b LEFT JOIN weld wc ON wc.vidx = c""", f"{TRI}, {WELD}")
q("welded_vertices", 'SELECT t AS "to", row_number() OVER (ORDER BY t) - 1 AS new FROM (SELECT DISTINCT t FROM weld)', f"{VERT}, {WELD}")
AREA = f"""{TRI}, pts AS (SELECT o.prim_id, o.tidx, o.a, o.b, o.c, {", ".join(f"v{c}.{a} AS {a}{c}, v{c}.n{a} AS n{a}{c}" for c in "abc" for a in "xyz")}
  FROM ok o JOIN vert va ON va.vidx = o.a JOIN vert vb ON vb.vidx = o.b JOIN vert vc ON vc.vidx = o.c
), cr AS (SELECT *, (yb - ya) * (zc - za) - (zb - za) * (yc - ya) AS ex, (zb - za) * (xc - xa) - (xb - xa) * (zc - za) AS ey, (xb - xa) * (yc - ya) - (yb - ya) * (xc - xa) AS ez FROM pts
), ar AS (SELECT *, ex * ex + ey * ey + ez * ez AS area2 FROM cr)"""
q("degenerate_cull", f"SELECT prim_id, tidx, round(area2, 6) AS area2 FROM ar WHERE a <> b AND b <> c AND a <> c AND area2 > {n(1e-20)}", AREA)
q("invalid_primitive_reject", "SELECT CAST(tidx // 10 AS BIGINT) AS prim_id, tidx FROM tri WHERE tidx // 10 NOT IN (SELECT tidx // 10 FROM tri WHERE a >= nv OR b >= nv OR c >= nv)", TRI)
q("triangle_budget", "SELECT prim_id, tidx FROM (SELECT *, row_number() OVER (ORDER BY area2, prim_id, tidx) AS r, count(*) OVER () AS n FROM ar) WHERE r > n - 500", AREA)
q("triangle_budget_per_tile", "SELECT prim_id, tidx FROM (SELECT *, row_number() OVER (PARTITION BY prim_id ORDER BY area2, prim_id, tidx) AS r, count(*) OVER (PARTITION BY prim_id) AS n FROM ar) WHERE r > n - 60", AREA)
q("fetch_compaction", """SELECT prim_id, vidx, row_number() OVER (PARTITION BY prim_id ORDER BY first_at) - 1 AS new FROM (
  SELECT prim_id, vidx, min(tidx * 3 + k) AS first_at FROM (SELECT prim_id, tidx, unnest([a, b, c]) AS vidx, unnest([0, 1, 2]) AS k FROM ok) GROUP BY 1, 2)""", TRI)
PRIM = f"{OCC}, prim AS (SELECT occ_id AS prim_id, size % 5 AS material, CAST(CASE WHEN size % 7 = 0 THEN 5 ELSE 4 END AS INTEGER) AS mode, size % 2 = 0 AS has_normals, size % 3 = 0 AS has_texcoord, false AS has_color, size * 3 AS n_vertices, size * 6 AS n_indices FROM occ)"
q("primitive_groups", """SELECT material, mode, has_normals, has_texcoord, has_color, CAST(bucket AS INTEGER) AS bucket, count(*) AS n_primitives, CAST(sum(n_vertices) AS BIGINT) AS n_vertices, CAST(sum(n_indices) AS BIGINT) AS n_indices
FROM (SELECT *, CASE WHEN mode = 4 THEN 0 ELSE row_number() OVER (PARTITION BY material, mode, has_normals, has_texcoord, has_color ORDER BY prim_id) - 1 END AS bucket FROM prim) GROUP BY ALL""", PRIM)
q("vertex_offsets", "SELECT prim_id, CAST(coalesce(sum(n_vertices) OVER (PARTITION BY material, mode ORDER BY prim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM prim", PRIM)
q("buffer_layout", """SELECT occ_id, padded, CAST(coalesce(sum(padded) OVER (PARTITION BY geometry_key ORDER BY occ_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM (
  SELECT *, CASE WHEN bytes = 0 AND lead(occ_id) OVER (PARTITION BY geometry_key ORDER BY occ_id) IS NOT NULL THEN 8 ELSE (bytes + 7) // 8 * 8 END AS padded
  FROM (SELECT *, CASE WHEN size % 9 = 0 THEN 0 ELSE size * 13 END AS bytes FROM occ))""", OCC)
q("material_dedup", f"SELECT occ_id AS midx, min(occ_id) OVER (PARTITION BY round(CAST(size AS DOUBLE) / 7 * 1024), round(CAST(size AS DOUBLE) / 50 * 1024)) AS \"to\" FROM occ", OCC)
q("black_colors", f"SELECT prim_id, bool_and(prim_id % 2 = 0 OR abs(u) <= {n(1e-6)}) AS all_black FROM vert GROUP BY 1", VERT)
CLUSTER = f"weld AS (SELECT vidx, min(vidx) OVER (PARTITION BY round(x / {n(0.1)}), round(y / {n(0.1)}), round(z / {n(0.1)})) AS t FROM vert)"
q("cluster_simplify", """SELECT prim_id, count(*) AS n, CAST(sum(a) AS BIGINT) AS sum_a FROM (
  SELECT prim_id, list_sort([wa.t, wb.t, wc.t]) AS key, arg_min(wa.t, tidx) AS a FROM ok JOIN weld wa ON wa.vidx = a JOIN weld wb ON wb.vidx = b JOIN weld wc ON wc.vidx = c
  WHERE wa.t <> wb.t AND wb.t <> wc.t AND wa.t <> wc.t GROUP BY 1, 2) GROUP BY 1""", f"{TRI}, {CLUSTER}")
q("instance_bake", f"SELECT n_nationkey AS instance_id, vidx, round(x + n_nationkey, 6) AS x, round(y + {n(1.0)}, 6) AS y, round(z + {n(0.5)}, 6) AS z FROM nation JOIN vert ON n_nationkey % 10 = prim_id", VERT)
q("normalized_decode", f"""SELECT event_id, round(CASE event_id % 6 WHEN 0 THEN greatest({n(-1.0)}, r / {n(127.0)}) WHEN 1 THEN greatest({n(0.0)}, r / {n(255.0)}) WHEN 2 THEN greatest({n(-1.0)}, r / {n(32767.0)})
  WHEN 3 THEN greatest({n(0.0)}, r / {n(65535.0)}) WHEN 4 THEN greatest({n(0.0)}, r / {n(4294967295.0)}) ELSE r END, 9) AS value FROM (SELECT event_id, CAST(event_id % 251 - 100 AS DOUBLE) AS r FROM events)""", "")
q("gltf_triangles", "SELECT material, CAST(sum(CASE WHEN mode = 4 THEN CASE WHEN has_normals THEN n_indices ELSE n_vertices END // 3 ELSE 0 END) AS BIGINT) AS triangles FROM prim GROUP BY 1", PRIM)

# -- probes and gates -------------------------------------------------------------

q("multi_normal_positions", """SELECT count(*) AS positions, count(*) FILTER (WHERE c > 1) AS several, max(c) AS most FROM (
  SELECT fx, fy, fz, count(DISTINCT round(nx / l * 10000)::BIGINT || ',' || round(ny / l * 10000)::BIGINT || ',' || round(nz / l * 10000)::BIGINT) AS c
  FROM (SELECT *, floor(x * 8) AS fx, floor(y * 8) AS fy, floor(z * 8) AS fz, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM vert) GROUP BY 1, 2, 3)""", VERT)
_ANG = " UNION ALL ".join(f"SELECT prim_id, degrees(acos(greatest(-1, least(1, ex / el * (nx{c} / sqrt(nx{c} * nx{c} + ny{c} * ny{c} + nz{c} * nz{c})) + ey / el * (ny{c} / sqrt(nx{c} * nx{c} + ny{c} * ny{c} + nz{c} * nz{c})) + ez / el * (nz{c} / sqrt(nx{c} * nx{c} + ny{c} * ny{c} + nz{c} * nz{c})))))) AS angle FROM (SELECT *, sqrt(area2) AS el FROM ar WHERE a <> b AND b <> c AND a <> c)" for c in "abc")
q("corner_angle_p95", f"""SELECT prim_id, round(avg(angle), 5) AS mean, round(max(angle), 5) AS largest, round(max(angle) FILTER (WHERE r = floor({n(0.95)} * (n - 1))), 5) AS percentile
FROM (SELECT *, row_number() OVER (PARTITION BY prim_id ORDER BY angle) - 1 AS r, count(*) OVER (PARTITION BY prim_id) AS n FROM ({_ANG})) GROUP BY 1""", AREA)
q("uv_range", "SELECT prim_id, min(u) AS u_min, max(u) AS u_max, min(v) AS v_min, max(v) AS v_max, count(*) AS n, count(*) FILTER (WHERE u < 0 OR u > 1 OR v < 0 OR v > 1) AS outside FROM vert GROUP BY 1", VERT)
q("uv_delta_histogram", f"SELECT floor(abs(u - v) / {n(0.125)}) * {n(0.125)} AS bucket, count(*) AS n FROM vert GROUP BY 1", VERT)
_KEY = "list_sort([{'x': round(xa, 9), 'y': round(ya, 9), 'z': round(za, 9)}, {'x': round(xb, 9), 'y': round(yb, 9), 'z': round(zb, 9)}, {'x': round(xc, 9), 'y': round(yc, 9), 'z': round(zc, 9)}])"
q("triangle_match", f"""SELECT l.prim_id, l.tidx, r.m.prim_id AS other_prim, r.m.tidx AS other_tidx FROM keyed l JOIN (SELECT key, min({{'prim_id': prim_id, 'tidx': tidx}}) AS m FROM keyed WHERE tidx % 2 = 0 GROUP BY key) r USING (key)""", f"{AREA}, keyed AS (SELECT prim_id, tidx, {_KEY} AS key FROM ar WHERE a <> b AND b <> c AND a <> c)")
q("id_uniqueness", "SELECT id % 1000 AS id, count(*) AS n FROM items GROUP BY 1 HAVING count(*) > 1")
q("tile_gates", "SELECT occ_id AS path, size % 4 >= 1 AND size >= 3 AND size * 2 >= 3 AND size * 2 % 3 = 0 AS geometry_ok, size % 11 <> 0 AS bounds_ok FROM occ", OCC)
q("fixture_contract", """SELECT fixture, o >= 1 AND e >= 2 AND false AS passed, (o < 1)::BIGINT + (e < 2)::BIGINT + 1 AS failures
FROM (SELECT geometry_key AS fixture, count(*) AS o, count(*) FILTER (WHERE from_explicit) AS e FROM occ GROUP BY 1)""", OCC)
q("proxy_collapse", f"SELECT occ_id AS path FROM occ WHERE size % 6 = 0 OR size % 5 = 0", OCC)

# -- exchange text ------------------------------------------------------------------

REC = f"""rec0 AS ({RECORDS}), rec AS (
  SELECT rec_no, text, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS norm FROM rec0
), cls AS (SELECT *, rec_no % 12 AS m, CASE WHEN rec_no % 12 < 11 THEN rec_no END AS entity_id, CASE rec_no % 12
    WHEN 0 THEN 'APPLIED_GROUP_ASSIGNMENT' WHEN 1 THEN 'APPLIED_GROUP_ASSIGNMENT' WHEN 2 THEN 'COMPLEX_TRIANGULATED_FACE' WHEN 3 THEN 'UNKNOWN' WHEN 4 THEN 'SURFACE_STYLE_RENDERING_WITH_PROPERTIES'
    WHEN 5 THEN 'GROUP_RELATIONSHIP' WHEN 6 THEN 'ITEM_DEFINED_TRANSFORMATION' WHEN 7 THEN 'PRODUCT_DEFINITION_SHAPE' WHEN 8 THEN 'SURFACE_SIDE_STYLE' WHEN 9 THEN 'TESSELLATED_SOLID' WHEN 10 THEN 'UNKNOWN' ELSE 'NON_ENTITY' END AS kind FROM rec
), ref AS (SELECT rec_no, kind, generate_subscripts(r, 1) AS k, CAST(unnest(r) AS BIGINT) AS ref FROM (SELECT rec_no, kind, regexp_extract_all(regexp_extract(norm, '\\((#[^)]*)\\)\\);', 1), '#(-?\\d+)', 1) AS r FROM cls WHERE m IN (8, 9)) WHERE len(r) > 0
), bad AS (SELECT rec_no, entity_id FROM cls WHERE m IN (0, 2) OR (m = 4 AND norm LIKE '%PROPERTIES($%')
), fit AS (SELECT ref.* FROM ref JOIN cls c ON c.entity_id = ref.ref WHERE (ref.kind = 'SURFACE_SIDE_STYLE' AND c.kind = 'SURFACE_STYLE_RENDERING_WITH_PROPERTIES') OR (ref.kind = 'TESSELLATED_SOLID' AND c.m IN (2, 3))
), live AS (SELECT * FROM fit WHERE ref NOT IN (SELECT entity_id FROM bad)
), gone AS (SELECT rec_no, 0 AS round FROM bad UNION ALL SELECT rec_no, 1 FROM cls WHERE m IN (8, 9) AND rec_no NOT IN (SELECT rec_no FROM live))"""
q("step_records", "SELECT rec_no, text FROM rec0_numbered", f"rec0 AS ({RECORDS}), rec0_numbered AS (SELECT row_number() OVER (ORDER BY rec_no) AS rec_no, text FROM rec0)")
q("step_classify", """SELECT rec_no, coalesce(entity_id, -1) AS entity_id, kind, CASE WHEN m = 3 THEN 'TRIANGULATED_FACE' WHEN m = 10 THEN 'REPRESENTATION_RELATIONSHIP,SHAPE_REPRESENTATION_RELATIONSHIP' WHEN m < 11 THEN kind ELSE '' END AS types FROM cls""", REC)
q("step_refs", "SELECT rec_no, ref FROM ref", REC)
q("step_removed", "SELECT rec_no, CAST(round AS INTEGER) AS round FROM gone", REC)
_PATCH = "CASE m WHEN 5 THEN replace(norm, '($,$,', '('''','''',') WHEN 6 THEN replace(norm, 'TRANSFORMATION($,', 'TRANSFORMATION('''',') WHEN 7 THEN replace(norm, 'SHAPE($,', 'SHAPE('''',') WHEN 10 THEN replace(norm, 'RELATIONSHIP($,', 'RELATIONSHIP('''',') END"
q("step_patch", f"SELECT rec_no, {_PATCH} AS text FROM cls WHERE m IN (5, 6, 7, 10)", REC)
q("step_sanitize", f"""SELECT cls.rec_no, CASE WHEN m IN (5, 6, 7, 10) THEN {_PATCH} WHEN m IN (8, 9) AND l.n < r.n THEN '#' || entity_id || '=' || kind || '('''',(' || l.t || '));' WHEN m IN (8, 9) THEN norm ELSE text END AS text,
  CASE WHEN m IN (5, 6, 7, 10) THEN 'patched' WHEN m IN (8, 9) AND l.n < r.n THEN 'filtered' ELSE 'kept' END AS action
FROM cls LEFT JOIN (SELECT rec_no, count(*) AS n, string_agg('#' || ref, ',' ORDER BY k) AS t FROM live GROUP BY 1) l ON l.rec_no = cls.rec_no
LEFT JOIN (SELECT rec_no, count(*) AS n FROM ref GROUP BY 1) r ON r.rec_no = cls.rec_no WHERE cls.rec_no NOT IN (SELECT rec_no FROM gone)""", REC)
q("step_stats", """SELECT count(*) AS records, count(entity_id) AS entities, count(*) FILTER (WHERE m = 0) AS empty_assignments, count(*) FILTER (WHERE m = 2) AS empty_strips, count(*) FILTER (WHERE m = 4 AND norm LIKE '%PROPERTIES($%') AS bad_renderings,
  count(*) FILTER (WHERE m IN (5, 6, 7, 10)) AS patchable, bool_or(text LIKE '%COLOUR%' OR text LIKE '%COLOR%') AS has_colors, bool_or(text LIKE '%MATERIAL%') AS has_materials FROM cls""", REC)
q("step_shards", "SELECT rec_no, CAST(ntile(7) OVER (ORDER BY rec_no) - 1 AS INTEGER) AS shard FROM cls WHERE entity_id IS NOT NULL", REC)
q("shard_integrity", "SELECT entity_id, 'lost' AS side FROM cls WHERE entity_id = 25", REC)
q("face_range_stub", "SELECT rec_no, '#' || entity_id || '=COMPLEX_TRIANGULATED_FACE('''',#14338,3,((0.,0.,0.)),$,(1,2,3),(),((1)));' AS text FROM cls WHERE m = 2 AND entity_id BETWEEN 20 AND 90", REC)
q("solid_retarget", "SELECT rec_no, CASE WHEN rec_no BETWEEN 1 AND 100 THEN regexp_replace(norm, '([(,])#\\d+', '\\1#7', 'g') ELSE text END AS text FROM cls WHERE m = 9", REC)
q("face_id_ranges", "SELECT CAST((entity_id - (SELECT min(entity_id) FROM cls WHERE m = 2)) // 50 AS BIGINT) AS run, min(entity_id) AS first_id, max(entity_id) AS last_id, count(*) AS n FROM cls WHERE m = 2 GROUP BY 1", REC)
q("importer_route", """SELECT occ_id, CASE WHEN size % 5 IN (1, 4) THEN 'fbx' ELSE 'step' END AS importer, 'application/octet-stream' AS mime, 'out/' || occ_id AS uri FROM occ""", OCC)
q("glb_roundtrip", "SELECT occ_id, 'ok' AS status, CAST(8 AS BIGINT) AS corners, CAST(36 AS BIGINT) AS indices, CAST(size AS DOUBLE) AS xmax FROM occ", OCC)
q("b3dm_wrap", "SELECT p_partkey AS occ_id, CAST(28 + 24 + (14 + l + 7) // 8 * 8 + 4 + l AS BIGINT) AS bytes, 'b3dm' AS magic FROM (SELECT p_partkey, strlen(p_name) AS l FROM part)", "")

from tessera.plans import model_oracles  # noqa: E402, F401  (adds the SQL of the model queries)
