"""DuckDB SQL of the model queries' rows, written apart from the queries."""

from __future__ import annotations

import math

from tessera.operators import tile_merge
from tessera.plans.oracles import _K, DEPTH, ITEMS, OCC, PRIM, PROTO, REC, TREE, TRI, VERT, _middle, n, q

_SIX = "CASE WHEN {0} = 0 THEN 0 ELSE round({0} / pow(CAST(10 AS DOUBLE), floor(log10(abs({0}))) - 5)) * pow(CAST(10 AS DOUBLE), floor(log10(abs({0}))) - 5) END"

q("cad_shape_keys", "SELECT occ_id, min(occ_id) OVER (PARTITION BY size) AS first_occ FROM occ", OCC)

# what an appearance consists of follows from the size; the third of a number of 0 to 4 keeps numbers apart
APP = f"""{OCC}, app AS (SELECT *, size % 10 <> 0 AS has, CASE WHEN size & 1 <> 0 THEN size % 3 END AS gen, CASE WHEN size & 2 <> 0 THEN size % 4 END AS surf, CASE WHEN size & 4 <> 0 THEN size % 5 END AS curv,
    size % 4 = 0 AS mat, size % 3 AS nf, CASE WHEN size % 2 = 0 THEN size % 7 END AS g0, CASE WHEN (size + 1) % 2 = 0 THEN size % 7 END AS g1, size % 5 = 0 AS m0, (size + 1) % 5 = 0 AS m1 FROM occ
), looks AS (SELECT *, CASE WHEN nf > 0 THEN coalesce(CAST(g0 AS VARCHAR), '-') || m0 ELSE '' END AS f0, CASE WHEN nf > 1 THEN coalesce(CAST(g1 AS VARCHAR), '-') || m1 ELSE '' END AS f1 FROM app)"""
q("cad_material_keys", "SELECT occ_id, min(occ_id) OVER (PARTITION BY CASE WHEN has THEN concat_ws('|', coalesce(gen, -1), coalesce(surf, -1), coalesce(curv, -1), mat, f0, f1) END) AS first_occ FROM looks", APP)
q("face_material_keys", """SELECT occ_id, face, min(occ_id * 2 + face) OVER (PARTITION BY CASE WHEN NOT has THEN 'none' WHEN face < nf THEN 'face' || CASE WHEN face = 0 THEN f0 ELSE f1 END
  ELSE concat_ws('|', 'shape', gen IS NULL, surf IS NULL, curv IS NULL, mat) END) AS first FROM looks, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS face)""", APP)
_MK = ", ".join(_SIX.format(f"round({x} * {n(100_000.0)})") for x in (f"(CAST(size AS DOUBLE) * {n(12.3456789)})", f"(CAST(size AS DOUBLE) * {n(12.3456789)} / 3)", f"(CAST(occ_id AS DOUBLE) * {n(1e-7)})"))
q("mesh_keys", f"SELECT occ_id, min(occ_id) OVER (PARTITION BY size % 9, size % 4, CASE WHEN size % 13 <> 0 THEN [{_MK}] END) AS first_occ FROM occ", OCC)
q("mesh_material_keys", f"""SELECT occ_id, min(occ_id) OVER (PARTITION BY CASE WHEN size % 8 <> 0 THEN concat_ws('|', size % 4, size % 2, CASE WHEN size % 3 = 0 THEN 'grey' ELSE round(CAST(size AS DOUBLE) / 997 * 1000) || ',' || round(CAST(size AS DOUBLE) / 50 * 1000) END) END) AS first_occ FROM occ""", OCC)
q("face_appearance_zip", """SELECT occ_id, CAST(place AS INTEGER) AS place, size % 5 <> size % 4 AS mismatch, CAST(place AS BIGINT) AS face, CAST(place * 10 AS BIGINT) AS appearance
FROM (SELECT *, unnest(range(least(size % 5, size % 4) + 1)) AS place FROM occ)""", OCC)
q("faces_with_appearance", "SELECT occ_id, has AND ((nf > 0 AND (g0 IS NOT NULL OR m0)) OR (nf > 1 AND (g1 IS NOT NULL OR m1))) AS \"any\" FROM looks", APP)
q("added_and_emitted", "SELECT * FROM (SELECT geometry_key, count(*) AS added, count(*) FILTER (WHERE size > 3) AS emitted FROM occ GROUP BY 1) WHERE added <> emitted", OCC)

MODEL = """model AS (SELECT n_nationkey AS model, n_nationkey % 4 + 1 AS np, n_nationkey % 3 + 1 AS nm FROM nation
), base AS (SELECT *, coalesce(sum(np) OVER w, 0) AS pb, coalesce(sum(nm) OVER w, 0) AS mb FROM model WINDOW w AS (ORDER BY model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), prims AS (SELECT *, CASE WHEN prim <> 2 THEN (model + prim * 2) % 5 END AS material FROM (SELECT *, unnest(range(np)) AS prim FROM base)
), mats AS (SELECT *, CAST(mb + midx AS BIGINT) AS new_midx, midx % 2 AS shade FROM (SELECT *, unnest(range(nm)) AS midx FROM base)
), named AS (SELECT *, CAST(pb + prim AS BIGINT) AS new_prim, CAST(CASE WHEN material < nm THEN mb + material END AS BIGINT) AS new_material FROM prims)"""
q("model_union", "SELECT model, prim, new_prim, coalesce(new_material, -1) AS new_material FROM named", MODEL)
q("model_union_materials", "SELECT new_prim, coalesce(t.first, -1) AS canonical FROM named LEFT JOIN (SELECT new_midx, min(new_midx) OVER (PARTITION BY shade) AS first FROM mats) t ON new_material = t.new_midx", MODEL)
q("primitive_materials", "SELECT model, prim, CASE WHEN material < nm THEN material % 2 ELSE -1 END AS shade FROM prims", MODEL)
q("used_resources", """SELECT 'material' AS kind, old, row_number() OVER (ORDER BY pos) - 1 AS new FROM mat UNION ALL SELECT 'texture', old, row_number() OVER (ORDER BY pos) - 1 FROM tex
UNION ALL SELECT 'image', old, row_number() OVER (ORDER BY pos, first) - 1 FROM img""", f"""{OCC}, mat AS (SELECT size AS old, min(occ_id) AS pos FROM occ WHERE size % 3 = 0 GROUP BY 1
), slot AS (SELECT old AS midx, 0 AS slot, old % 7 AS texture FROM mat WHERE old % 2 = 0 UNION ALL SELECT old, 1, old % 5 + 5 FROM mat
), tex AS (SELECT texture AS old, min(midx * 2 + slot) AS pos FROM slot GROUP BY 1
), img AS (SELECT old % 4 AS old, min(pos) AS pos, arg_min(old, pos) AS first FROM tex WHERE old < 12 GROUP BY 1)""")
q("texture_use", "SELECT geometry_key AS model, bool_or(size > 48) AS any_texture, bool_or(size > 49) AS any_texcoord, bool_or(size > 48) AS weld_texcoord FROM occ GROUP BY 1", OCC)
q("alpha_modes", "SELECT geometry_key, count(*) AS materials, count(*) FILTER (WHERE size % 3 = 2) AS blend, count(*) FILTER (WHERE size % 3 = 1) AS mask FROM occ GROUP BY 1", OCC)
q("viewer_materials", """SELECT count(*) AS materials, count(*) FILTER (WHERE size % 2 = 0) AS pbr, count(*) FILTER (WHERE size % 2 = 0 AND size < 50) AS blend, count(*) FILTER (WHERE size % 10 = 0) AS mask,
  count(*) FILTER (WHERE size % 7 = 0) AS vertex_colors, count(*) FILTER (WHERE size % 2 = 0 AND size >= 48 AND size % 3 <> 0) AS less_metal FROM occ""", OCC)
q("mesh_spheres", f"""SELECT mesh, source, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(radius, 6) AS radius FROM (
  SELECT DISTINCT prim_id AS mesh, 'sphere' AS source, {n(1.0)} AS x, {n(2.0)} AS y, {n(3.0)} AS z, CAST(prim_id AS DOUBLE) AS radius FROM vert WHERE prim_id % 3 = 0 AND prim_id > 0
  UNION ALL SELECT DISTINCT prim_id, 'box', 1, 2, 2, 3 FROM vert WHERE prim_id % 3 = 1
  UNION ALL SELECT prim_id, 'points', (min(x) + max(x)) / 2, (min(y) + max(y)) / 2, (min(z) + max(z)) / 2, sqrt((max(x) - min(x)) ^ 2 + (max(y) - min(y)) ^ 2 + (max(z) - min(z)) ^ 2) / 2
    FROM (SELECT *, count(*) OVER (PARTITION BY prim_id) AS c FROM vert) WHERE (prim_id % 3 = 2 OR prim_id = 0) AND vidx // 10 % greatest(1, ceil(c / {n(20.0)})) = 0 GROUP BY 1) WHERE radius > 0""", VERT)
# p's corners lie a unit apart on x, q is p turned by one place and shifted by at most a fifth
q("corner_pairs", f"SELECT vidx, '1,2,0' AS places, round(abs((x * 4 + 1 + (vidx % 5) * {n(0.05)}) - (x * 4 + 1)), 6) AS farthest FROM vert WHERE vidx % 5 <= 2", VERT)
q("instance_files", """SELECT instance_id, CASE WHEN prototype_id % 4 = 0 THEN 'missing' ELSE 'p' || prototype_id END AS uri, CASE WHEN prototype_id % 4 <> 0 AND instance_id < 50 THEN 'low' || instance_id ELSE '' END AS low_uri
FROM (SELECT row_number() OVER (ORDER BY occ_id) - 1 AS instance_id, prototype_id, occ_id FROM occ JOIN proto USING (qualified_key)) WHERE prototype_id % 4 = 0 OR occ_id % 9 <> 0""", PROTO)
q("referred_labels", """SELECT 'n' || n_nationkey AS label, CASE WHEN n_nationkey % 2 = 0 THEN 'r' || n_regionkey ELSE 'n' || n_nationkey END AS target,
  CAST(n_nationkey + CASE WHEN n_nationkey % 2 = 0 AND n_regionkey <> 4 THEN n_regionkey * 100 ELSE 0 END AS DOUBLE) AS x, CAST(CASE WHEN n_nationkey % 2 = 0 AND n_regionkey <> 4 THEN 2 ELSE 1 END AS DOUBLE) AS y FROM nation""", "")
q("tile_prototypes", "SELECT m.path, count(*) AS n_items, count(DISTINCT i.part % 100) AS n_prototypes FROM members m JOIN items i ON i.id = m.item_id GROUP BY 1", TREE)

# content of the tiles, level by level from the deepest: triangles as three sorted corners
_SIDE = "(SELECT greatest(rxmax - rxmin, rymax - rymin, rzmax - rzmin) FROM root)"
_CORNERS = "[{'x': xmin, 'y': ymin, 'z': zc}, {'x': xmax, 'y': ymin, 'z': zc}, {'x': xmax, 'y': ymax, 'z': zc}, {'x': xmin, 'y': ymax, 'z': zc}]"
_MERGE = f"""{TREE}, own AS (SELECT m.path, i.part % 5 AS material, {_CORNERS} AS c FROM members m JOIN (SELECT *, (zmin + zmax) * {n(0.5)} AS zc FROM items) i ON i.id = m.item_id
), flat AS (SELECT path, material, list_sort(t) AS t FROM (SELECT path, material, [c[1], c[2], c[3]] AS t FROM own UNION ALL SELECT path, material, [c[1], c[3], c[4]] FROM own)
), t{DEPTH + 1} AS (SELECT * FROM flat WHERE false)"""
for _d in range(DEPTH, -1, -1):
    _step = f"{_SIDE} * pow({n(0.9)}, {_d}) * {n(1 / 64)}"
    _move = ", ".join(f"'{a}': (floor(p.{a} / step) + {n(0.5)}) * step" for a in "xyz")
    _MERGE += f""", t{_d} AS MATERIALIZED (SELECT DISTINCT path, material, t FROM (SELECT * FROM flat WHERE len(path) = {_d}
      UNION ALL SELECT left(path, {_d}), material, list_sort(list_transform(t, lambda p: {{{_move}}})) FROM t{_d + 1}, (SELECT {_step} AS step)) WHERE t[1] <> t[2] AND t[2] <> t[3])"""
q("merge_tiles", f"""SELECT path, count(*) AS triangles, count(DISTINCT material) AS materials, any_value(v) AS vertices FROM every JOIN (SELECT path, count(*) AS v FROM (SELECT DISTINCT path, unnest(t) AS p FROM every) GROUP BY 1) USING (path) GROUP BY 1""",
  f"{_MERGE}, every AS ({' UNION ALL '.join(f'SELECT * FROM t{_k}' for _k in range(DEPTH + 1))})")

# the same with attributes: at each depth above its leaf, a triangle's corners are in cells of that
# depth's grid; a cell's place and attributes come from sums over all corners in it
_HALVED = "[" + ", ".join(map(str, tile_merge.grid_levels(1.8))) + "]"
_SETS = {"nx": "normal", "ny": "normal", "nz": "normal", "u": "texcoord", "v": "texcoord", "r": "color", "g": "color", "b": "color", "a": "color"}


def _corner(k: int) -> str:
    x, y, z = (("xmin", "ymin", "zmin"), ("xmax", "ymin", "zmin"), ("xmax", "ymax", "zmax"), ("xmin", "ymax", "zmax"))[k]
    normal, color = "CASE WHEN part % 5 <> 3 THEN {} END", "CASE WHEN part % 5 <> 4 THEN {} END"
    made = {"x": x, "y": y, "z": z, "nx": normal.format(f"(part % 7 - 3) / {n(4.0)}"), "ny": normal.format(f"(part % 5 - 2) / {n(4.0)}"), "nz": normal.format(n(1.0))}
    made |= {"u": f"{n(k / 4)} + (part % 10) / {n(40.0)}", "v": f"(part % 3) / {n(4.0)}", "r": color.format(f"(part % 4) / {n(4.0)}"), "g": color.format(n(k / 8)), "b": color.format(n(0.5)), "a": color.format(n(1.0))}
    return "{" + ", ".join(f"'{a}': CAST({v} AS DOUBLE)" for a, v in made.items()) + "}"


_Q = [(i, j) for i in range(4) for j in range(i, 4)]
_ALL = ("x", "y", "z", *_SETS)


def _det(m: list[list[str]]) -> str:
    a, b, c = m
    return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"


_A = [[f"(q{min(i, j)}{max(i, j)}" + (f" + w * {n(0.01)})" if i == j else ")") for j in range(3)] for i in range(3)]
_RIGHT = [f"(w * {n(0.01)} * (s{x} / w) - q{i}3)" for i, x in enumerate("xyz")]
_SOLVED = [f"{_det([[_RIGHT[i] if j == k else _A[i][j] for j in range(3)] for i in range(3)])} / {_det(_A)}" for k in range(3)]
_CONTENT = f"""{TREE}, grid AS (SELECT *, {_SIDE} * {n(1 / 64)} AS step, {_HALVED} AS halved FROM root
), own AS (SELECT m.path, i.part % 5 AS material, [{', '.join(map(_corner, range(4)))}] AS c FROM members m JOIN items i ON i.id = m.item_id
), raw AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT path, material, unnest([[c[1], c[2], c[3]], [c[1], c[3], c[4]]]) AS t FROM own) WHERE ({' AND '.join(f"(t[{i}].x, t[{i}].y, t[{i}].z) <> (t[{j}].x, t[{j}].y, t[{j}].z)" for i, j in ((1, 2), (2, 3), (1, 3)))})
), near AS (SELECT id, path, material, list_transform(t, lambda p: {{'x': p.x - rxmin, 'y': p.y - rymin, 'z': p.z - rzmin, {', '.join(f"'{x}': p.{x}" for x in _SETS)}}}) AS t FROM raw, grid
), plane AS (SELECT *, [t[2].x - t[1].x, t[2].y - t[1].y, t[2].z - t[1].z] AS e, [t[3].x - t[1].x, t[3].y - t[1].y, t[3].z - t[1].z] AS f FROM near
), cross_ AS (SELECT *, [e[2] * f[3] - e[3] * f[2], e[3] * f[1] - e[1] * f[3], e[1] * f[2] - e[2] * f[1]] AS c FROM plane
), unit AS (SELECT id, path, material, t, greatest(sqrt(c[1] * c[1] + c[2] * c[2] + c[3] * c[3]) / 2, {n(1e-12)}) AS w, list_transform(c, lambda v: CASE WHEN c[1] * c[1] + c[2] * c[2] + c[3] * c[3] > 0 THEN v / sqrt(c[1] * c[1] + c[2] * c[2] + c[3] * c[3]) ELSE 0 END) AS u FROM cross_
), full_ AS (SELECT *, list_append(u, -(u[1] * t[1].x + u[2] * t[1].y + u[3] * t[1].z)) AS o FROM unit
), up AS MATERIALIZED (SELECT id, left(path, d) AS path, d, material, w, o, unnest(t) AS p, unnest([1, 2, 3]) AS k, list_extract(halved, len(path) + 1) AS fine, list_extract(halved, d + 1) AS coarse, step
  FROM (SELECT *, unnest(range(0, len(path))) AS d FROM full_), grid
), cell AS MATERIALIZED (SELECT id, path, d, material, w, o, p, k, step / pow(2, coarse) AS size, {', '.join(f'CAST(floor(floor(p.{x} / (step / pow(2, fine))) / pow(2, fine - coarse)) AS BIGINT) AS c{x}' for x in 'xyz')} FROM up
), part_ AS MATERIALIZED (SELECT path, any_value(size) AS size, material, cx, cy, cz, sum(w) AS w, {', '.join(f'sum(w * o[{i + 1}] * o[{j + 1}]) AS q{i}{j}' for i, j in _Q)}, {', '.join(f'sum(w * p.{x}) AS s{x}' for x in _ALL)},
  sum(w) FILTER (p.u IS NOT NULL) AS w_texcoord, sum(w) FILTER (p.r IS NOT NULL) AS w_color FROM cell GROUP BY path, material, cx, cy, cz
), place AS (SELECT path, cx, cy, cz, any_value(size) AS size, {', '.join(f'sum({c}) AS {c}' for c in ('w', *(f'q{i}{j}' for i, j in _Q), 'sx', 'sy', 'sz'))} FROM part_ GROUP BY ALL
), solved AS (SELECT path, cx, cy, cz, {', '.join(f'greatest(c{x} * size, least((c{x} + 1) * size, {v})) + r{x}min AS {x}' for x, v in zip('xyz', _SOLVED, strict=True))} FROM place, grid
), corner AS MATERIALIZED (SELECT path, material, {{'x': cx, 'y': cy, 'z': cz}} AS cell, {{'x': x, 'y': y, 'z': z, {', '.join(f"'{a}': " + (f'CASE WHEN sqrt(snx * snx + sny * sny + snz * snz) > {n(1e-24)} THEN s{a} / sqrt(snx * snx + sny * sny + snz * snz) END' if s == 'normal' else f's{a} / w_{s}') for a, s in _SETS.items())}}} AS p
  FROM part_ JOIN solved USING (path, cx, cy, cz)
), tri AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT path, material, s FROM (SELECT path, material, list_sort(list({{'x': cx, 'y': cy, 'z': cz}})) AS s FROM cell GROUP BY id, path, material) WHERE s[1] <> s[2] AND s[2] <> s[3])
), merged AS (SELECT e.path, e.material, list(p) AS t FROM (SELECT id, path, material, unnest(s) AS cell FROM tri) e JOIN corner USING (path, material, cell) GROUP BY id, e.path, e.material)"""  # fmt: skip
q("merge_tiles_attributes", f"""SELECT path, count(*) FILTER (WHERE k = 1) AS triangles, count(DISTINCT material) AS materials, {', '.join(f'round(coalesce(sum(p.{x}), 0), 4) AS sum_{x}' for x in _ALL)}
FROM (SELECT path, material, unnest(t) AS p, unnest([1, 2, 3]) AS k FROM (SELECT path, material, t FROM raw UNION ALL SELECT path, material, t FROM merged)) GROUP BY path""", _CONTENT)
q("tile_models", "SELECT path, CAST(material AS INTEGER) AS material, count(*) * 3 AS indices, material <> 3 AS has_normals, true AS has_texcoords, material <> 4 AS has_colors FROM (SELECT path, material FROM raw UNION ALL SELECT path, material FROM merged) GROUP BY ALL", _CONTENT)

_FACES = "(nf > 0 AND has AND {0})::INT + (nf > 1 AND has AND {1})::INT"
q("import_evidence", f"""SELECT count(*) AS occurrences, count(DISTINCT qualified_key) AS prototypes, count(*) FILTER (WHERE has AND (gen IS NOT NULL OR surf IS NOT NULL OR curv IS NOT NULL)) AS shape_color_occurrences,
  count(*) FILTER (WHERE has AND mat) AS shape_material_occurrences, CAST(sum({_FACES.format('g0 IS NOT NULL', 'g1 IS NOT NULL')}) AS BIGINT) AS face_color_entries, CAST(sum({_FACES.format('m0', 'm1')}) AS BIGINT) AS face_material_entries,
  count(*) FILTER (WHERE {_FACES.format('(g0 IS NOT NULL OR m0)', '(g1 IS NOT NULL OR m1)')} > 0) AS occurrences_with_face_style, CAST(sum(CASE WHEN has THEN nf ELSE 0 END) AS BIGINT) AS face_slots,
  CAST(sum(size) AS BIGINT) AS source_faces, count(*) FILTER (WHERE size % 6 = 0) AS metadata_occurrences FROM looks""", APP)
q("export_evidence", f"""SELECT 'high/' || geometry_key || '.glb' AS glb, count(*) AS occurrences, CAST(sum(triangles) AS BIGINT) AS source_triangles, CAST(sum(CASE WHEN size % 9 = 0 THEN 0 ELSE triangles END) AS BIGINT) AS glb_triangles,
  count(*) FILTER (WHERE has AND (surf IS NOT NULL OR gen IS NOT NULL)) AS shape_color_applied, count(*) FILTER (WHERE has AND mat) AS shape_material_applied, count(*) FILTER (WHERE has AND nf > 0) AS occurrences_with_faces,
  CAST(sum({_FACES.format('g0 IS NOT NULL', 'g1 IS NOT NULL')}) AS BIGINT) AS face_color_applied, CAST(sum({_FACES.format('m0', 'm1')}) AS BIGINT) AS face_material_applied, CAST(0 AS BIGINT) AS face_mismatches,
  {n(80.0)} AS sse, {n(0.01)} AS linear_deflection, {n(15.0)} AS angular_deflection, CASE WHEN sum(CASE WHEN size % 9 = 0 THEN 0 ELSE triangles END) > 0 THEN 'ok' ELSE 'error' END AS status FROM looks GROUP BY geometry_key""", APP)

_WHY = """, why AS (SELECT ref.rec_no, ref.kind, CASE WHEN b.entity_id IS NOT NULL THEN 'removed' WHEN c.entity_id IS NULL THEN 'unknown' WHEN f.rec_no IS NULL THEN 'unsuitable' END AS why
  FROM ref LEFT JOIN (SELECT DISTINCT cls.entity_id FROM gone JOIN cls USING (rec_no)) b ON b.entity_id = ref.ref LEFT JOIN cls c ON c.entity_id = ref.ref LEFT JOIN fit f ON f.rec_no = ref.rec_no AND f.k = ref.k)"""
_LOST = ", ".join(f"(SELECT count(*) FROM gone JOIN cls USING (rec_no) WHERE kind = '{k}') AS removed_{v}" for k, v in (("APPLIED_GROUP_ASSIGNMENT", "assignments"), ("COMPLEX_TRIANGULATED_FACE", "faces"), ("SURFACE_STYLE_RENDERING_WITH_PROPERTIES", "renderings"), ("SURFACE_SIDE_STYLE", "side_styles"), ("TESSELLATED_SOLID", "solids")))
_SKIP = ", ".join(f"(SELECT count(*) FROM why WHERE kind = '{k}' AND why = '{w}') AS {w}_{v}_refs" for k, v in (("SURFACE_SIDE_STYLE", "side_style"), ("TESSELLATED_SOLID", "solid")) for w in ("removed", "unknown", "unsuitable"))
_LESS = ", ".join(f"(SELECT count(DISTINCT rec_no) FROM why WHERE kind = '{k}' AND why IS NOT NULL AND rec_no NOT IN (SELECT rec_no FROM gone)) AS filtered_{v}s" for k, v in (("SURFACE_SIDE_STYLE", "side_style"), ("TESSELLATED_SOLID", "solid")))
_FIX = ", ".join(f"(SELECT count(*) FROM cls WHERE m = {m}) AS patched_{v}" for m, v in ((5, "groups"), (6, "transformations"), (7, "shapes"), (10, "relationships")))
q("step_statistics", f"""SELECT {_LOST}, (SELECT count(*) FROM gone) AS removed_ids, {_FIX}, {_SKIP}, {_LESS}, count(*) AS records, count(*) FILTER (WHERE text LIKE '%COLOUR%' OR text LIKE '%COLOR%') AS color_hits,
  count(*) FILTER (WHERE text LIKE '%MATERIAL%') AS material_hits, bool_or(text LIKE '%COLOUR%' OR text LIKE '%COLOR%') AS has_colors, bool_or(text LIKE '%MATERIAL%') AS has_materials FROM cls""", REC + _WHY)
q("step_shard_texts", """SELECT shard, count(*) FILTER (WHERE own) AS entities, sha256(string_agg(text, chr(10) ORDER BY rec_no) || chr(10)) AS sha256 FROM (
  SELECT CAST(ntile(7) OVER (ORDER BY rec_no) - 1 AS INTEGER) AS shard, rec_no, text, true AS own FROM cls WHERE entity_id IS NOT NULL
  UNION ALL SELECT CAST(s AS INTEGER), rec_no, text, false FROM cls, range(7) t(s) WHERE entity_id IS NULL AND (rec_no < (SELECT min(rec_no) FROM cls WHERE entity_id IS NOT NULL) OR rec_no > (SELECT max(rec_no) FROM cls WHERE entity_id IS NOT NULL))) GROUP BY 1""", REC)

_OPT = f"""{TRI}, weld AS (SELECT vidx, min(vidx) OVER (PARTITION BY round(x / {n(0.05)}), round(y / {n(0.05)}), round(z / {n(0.2)})) AS t FROM vert
), valid AS (SELECT * FROM tri WHERE prim_id NOT IN (SELECT prim_id FROM tri WHERE a >= nv OR b >= nv OR c >= nv)
), moved AS (SELECT prim_id, tidx, wa.t AS a, wb.t AS b, wc.t AS c FROM valid JOIN weld wa ON wa.vidx = a JOIN weld wb ON wb.vidx = b JOIN weld wc ON wc.vidx = c
), apart AS (SELECT * FROM moved WHERE a <> b AND b <> c AND a <> c
), area AS (SELECT *, ((yb - ya) * (zc - za) - (zb - za) * (yc - ya)) ^ 2 + ((zb - za) * (xc - xa) - (xb - xa) * (zc - za)) ^ 2 + ((xb - xa) * (yc - ya) - (yb - ya) * (xc - xa)) ^ 2 AS area2 FROM (
  SELECT o.*, va.x AS xa, va.y AS ya, va.z AS za, vb.x AS xb, vb.y AS yb, vb.z AS zb, vc.x AS xc, vc.y AS yc, vc.z AS zc FROM apart o JOIN vert va ON va.vidx = a JOIN vert vb ON vb.vidx = b JOIN vert vc ON vc.vidx = c)
), solid AS (SELECT *, row_number() OVER (ORDER BY area2 DESC, prim_id DESC, tidx DESC) AS r FROM area WHERE area2 > {n(1e-20)}
), kept AS (SELECT * FROM solid WHERE r <= 5000)"""
q("optimizer_statistics", """SELECT (SELECT count(DISTINCT prim_id) FROM tri) AS primitives_seen, (SELECT count(DISTINCT prim_id) FROM valid) AS primitives_extracted,
  (SELECT count(DISTINCT prim_id) FROM tri) - (SELECT count(DISTINCT prim_id) FROM valid) AS primitives_with_bad_indices, (SELECT count(*) FROM weld) AS input_vertices, (SELECT count(DISTINCT t) FROM weld) AS merged_vertices,
  (SELECT count(DISTINCT v) FROM (SELECT unnest([a, b, c]) AS v FROM kept)) AS output_vertices, (SELECT count(*) FROM tri) AS input_triangles, (SELECT count(*) FROM kept) AS output_triangles,
  (SELECT count(*) FROM moved) - (SELECT count(*) FROM apart) AS degenerate_by_corner, (SELECT count(*) FROM apart) - (SELECT count(*) FROM solid) AS degenerate_by_area,
  (SELECT count(*) FROM moved) - (SELECT count(*) FROM solid) AS removed_by_weld, (SELECT count(*) FROM solid) - (SELECT count(*) FROM kept) AS removed_by_budget""", _OPT)
q("simplify_checks", "SELECT prim_id, count(*) AS before, greatest(1, count(*) // 2) AS target, true AS fewer, true AS kept, true AS tight, true AS known, true AS solid, true AS once FROM ok WHERE a <> b AND b <> c AND a <> c GROUP BY 1", TRI)
q("material_rules", f"""SELECT occ_id, CASE WHEN size % 3 = 0 THEN {n(0.25)} WHEN size % 2 = 0 THEN {n(0.1)} ELSE {n(0.7)} END AS red, CASE WHEN size % 3 = 0 THEN {n(1.0)} WHEN size % 2 = 0 THEN {n(0.4)} ELSE {n(1.0)} END AS alpha,
  CASE WHEN ch < size % 6 THEN ch ELSE -1 END AS channel, round(CASE WHEN size % 4 = 0 THEN size / {n(50.0)} ELSE 0 END, 6) AS metallic, round(CASE WHEN size % 7 = 0 OR size % 5 = 0 THEN 1 ELSE size / {n(50.0)} END, 6) AS roughness,
  round(CASE WHEN size >= 48 AND size % 4 <> 0 THEN {n(0.1)} ELSE size / {n(50.0)} END, 6) AS shown_metallic, round(CASE WHEN size >= 48 AND size % 4 <> 0 THEN greatest(size / {n(100.0)}, {n(0.8)}) ELSE size / {n(100.0)} END, 6) AS shown_roughness, true AS double_sided
FROM (SELECT *, CASE WHEN size % 3 = 0 THEN size % 4 WHEN size % 2 = 0 THEN size % 5 ELSE 0 END AS ch FROM occ)""", OCC)
q("primitive_group_order", """SELECT row_number() OVER (ORDER BY material, mode, has_normals, has_texcoord, bucket) - 1 AS group_id, * FROM (SELECT DISTINCT material, mode, has_normals, has_texcoord, CAST(bucket AS INTEGER) AS bucket
FROM (SELECT *, CASE WHEN mode = 4 THEN 0 ELSE row_number() OVER (PARTITION BY material, mode, has_normals, has_texcoord ORDER BY prim_id) - 1 END AS bucket FROM prim))""", PRIM)
q("union_occurrences", "SELECT row_number() OVER (ORDER BY file, file_occ) - 1 AS occ_id, file, file_occ FROM (SELECT CAST(1 - occ_id % 2 AS INTEGER) AS file, occ_id AS file_occ FROM occ)", OCC)
q("face_ids", "SELECT DISTINCT entity_id FROM cls WHERE kind = 'COMPLEX_TRIANGULATED_FACE'", REC)
q("attribute_simplify", "SELECT prim_id, count(*) AS before, greatest(1, count(*) // 2) AS target, true AS fewer, true AS kept, true AS tight, true AS known, true AS solid, true AS once FROM ok WHERE a <> b AND b <> c AND a <> c GROUP BY 1", TRI)
q("baked_occurrences", "SELECT 'occ_' || n_nationkey || '_high.glb' AS file, 'ok' AS status, count(*) AS corners, count(*) // 3 * 3 AS indices, round(CAST(max(CAST(x + n_nationkey AS FLOAT)) AS DOUBLE), 4) AS xmax FROM nation JOIN vert ON n_nationkey % 10 = prim_id GROUP BY n_nationkey", VERT)
q("tileset_files", """SELECT 'tileset' || CASE WHEN file = '' THEN '' ELSE '_' || file END || '.json' AS uri, count(*) AS tiles, count(*) FILTER (WHERE refers) AS refers FROM (
  SELECT CASE WHEN depth > 0 AND depth % 2 = 0 AND is_leaf THEN left(path, depth - 2) ELSE left(path, depth // 2 * 2) END AS file, false AS refers FROM nodes
  UNION ALL SELECT left(path, depth - 2), true FROM nodes WHERE depth > 0 AND depth % 2 = 0 AND NOT is_leaf) GROUP BY 1""", TREE)
q("volume_spheres", "SELECT occ_id, CAST(CASE size % 3 WHEN 0 THEN size WHEN 1 THEN 0 ELSE -1 END AS DOUBLE) AS x, CAST(CASE size % 3 WHEN 0 THEN 0 WHEN 1 THEN size ELSE -1 END AS DOUBLE) AS y, CASE size % 3 WHEN 0 THEN 3 * CAST(size AS DOUBLE) WHEN 1 THEN size / CAST(2 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS radius FROM occ", OCC)

# tiles from above: fine enough ones without a fine enough one above them
_HALF = " * ".join(("(r{0}max - r{0}min)", f"pow({n(0.9)}, len(path))", n(0.5)))
_AWAY = " + ".join("pow(greatest(m{0} - {1} - c{0}, 0, c{0} - m{0} - {1}), 2)".format(a, _HALF.format(a)) for a in "xyz")
q("visible_tiles", f"""SELECT s.camera, s.path, round(s.error, 6) AS error FROM enough s ANTI JOIN (
  SELECT u.camera, u.path FROM (SELECT camera, path, left(path, unnest(range(0, depth))) AS up FROM enough) u JOIN enough e ON e.camera = u.camera AND e.path = u.up) h ON h.camera = s.camera AND h.path = s.path""",
  f"""{_K}, views AS (SELECT CAST(n_nationkey AS BIGINT) AS camera, CAST(n_nationkey * 9 - 50 AS DOUBLE) AS cx, CAST(n_regionkey * 15 - 5 AS DOUBLE) AS cy, CAST(n_nationkey % 7 * 12 AS DOUBLE) AS cz FROM nation
), mids AS (SELECT path, depth, is_leaf, CASE WHEN is_leaf THEN 0 ELSE own_error END AS error, {', '.join(f'{_middle(a, 1 << i)} AS m{a}' for i, a in enumerate('xyz'))}, {', '.join(f'r{a}min, r{a}max' for a in 'xyz')} FROM settings, root
), away AS (SELECT *, sqrt({_AWAY}) AS dist FROM mids, views
), enough AS MATERIALIZED (SELECT camera, path, depth, error FROM away WHERE is_leaf OR depth >= 6 OR (dist > 0 AND error * {n(1080 / (2 * math.tan(math.radians(60) / 2)))} <= 80 * dist))""")  # fmt: skip

_ZONE = f"""{ITEMS}, zc AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 997 = 0 THEN {n(6.0)} ELSE {n(0.25)} END AS h, o_totalprice / {n(5000.0)} AS x, CAST(o_custkey % 50 AS DOUBLE) AS y, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) / {n(50.0)} AS z FROM orders
), zones AS (SELECT id, {', '.join(f'{a} - h AS z{a}min, {a} + h AS z{a}max' for a in 'xyz')} FROM zc)"""
q("box_pairs", f"SELECT i.id AS item, z.id AS zone FROM items i JOIN zones z ON {' AND '.join(f'{a}min <= z{a}max AND z{a}min <= {a}max' for a in 'xyz')}", _ZONE)
q("boxes_inside", f"SELECT z.id AS zone, count(*) AS items FROM items i JOIN zones z ON {' AND '.join(f'{a}min >= z{a}min AND {a}max <= z{a}max' for a in 'xyz')} GROUP BY 1", _ZONE)
q("deep_assembly", f"""SELECT 'n' || k AS node, CAST(k % 100 AS BIGINT) AS depth, round(CAST(coalesce(sum(m % 5) OVER w, 0) AS DOUBLE), 6) AS x, round(CAST(k % 100 AS DOUBLE), 6) AS y, round(CAST(coalesce(sum(m) OVER w, 0) AS DOUBLE), 6) AS z,
  CAST(sum(CASE WHEN k % 100 = 0 THEN length('n' || k) ELSE length('/n' || k || '#mesh_0') END) OVER w AS BIGINT) AS path_length,
  left(string_agg(CASE WHEN k % 100 = 0 THEN 'n' || k ELSE '/n' || k || '#mesh_' || k % 3 END, '') OVER w, 40) AS path_start
FROM (SELECT CAST(c_custkey AS BIGINT) AS k, CASE WHEN c_custkey % 100 <> 0 THEN c_custkey END AS m FROM customer) WINDOW w AS (PARTITION BY k // 100 ORDER BY k)""", "")

q("occurrence_filter", f"""SELECT prim_id, triangles, {', '.join(f'round(any_value({a}{e}), 6) AS {a}{e}' for a in 'xyz' for e in ('min', 'max'))} FROM (SELECT prim_id, count(*) AS triangles FROM ok WHERE a <> b AND b <> c AND a <> c AND prim_id % 4 <> 1 GROUP BY 1) t,
  (SELECT {', '.join(f'{f}({a}) AS {a}{f}' for a in 'xyz' for f in ('min', 'max'))} FROM vert) WHERE prim_id IN (SELECT prim_id FROM vert) GROUP BY 1, 2""", TRI)
q("geometry_statistics", """SELECT count(DISTINCT prim_id) + 3 AS meshes, count(DISTINCT prim_id) AS with_positions, count(*) AS positions, count(*) FILTER (WHERE r <= 16) AS samples_tried,
  count(*) FILTER (WHERE r <= 16 AND vidx % 7 <> 0 AND vidx % 11 <> 0) AS finite_samples, count(*) FILTER (WHERE r <= 16 AND (vidx % 7 = 0 OR vidx % 11 = 0)) AS invalid_samples
FROM (SELECT *, row_number() OVER (PARTITION BY prim_id ORDER BY vidx) AS r FROM vert)""", VERT)
# a quarter turn about z, z doubled: the common factor goes with the length
q("direction_moves", "SELECT vidx, round(CASE WHEN l > 0 THEN -ny / l ELSE 0 END, 6) AS x, round(CASE WHEN l > 0 THEN nx / l ELSE 0 END, 6) AS y, round(CASE WHEN l > 0 THEN 2 * nz / l ELSE 0 END, 6) AS z FROM (SELECT *, sqrt(nx * nx + ny * ny + 4 * nz * nz) AS l FROM vert)", VERT)
_NEAR = " AND ".join("(" + " OR ".join("(" + " AND ".join(f"abs(l.{a}{i} - r.{a}{k} - r.s) <= {n(0.003)}" for a in "xyz") + ")" for k in "abc") + ")" for i in "abc")
q("near_triangles", f"SELECT DISTINCT l.prim_id, l.tidx FROM cornered l JOIN cornered r ON l.xa >= r.lo + r.s - {n(0.0031)} AND l.xa <= r.hi + r.s + {n(0.0031)} AND l.ya >= r.ylo + r.s - {n(0.0031)} AND l.ya <= r.yhi + r.s + {n(0.0031)} AND {_NEAR}",
  f"""{TRI}, cornered AS MATERIALIZED (SELECT o.prim_id, o.tidx, {', '.join(f'v{c}.{a} AS {a}{c}' for c in 'abc' for a in 'xyz')}, (o.tidx % 3) * {n(0.004)} + {n(0.0005)} AS s,
  least(va.x, vb.x, vc.x) AS lo, greatest(va.x, vb.x, vc.x) AS hi, least(va.y, vb.y, vc.y) AS ylo, greatest(va.y, vb.y, vc.y) AS yhi FROM ok o JOIN vert va ON va.vidx = o.a JOIN vert vb ON vb.vidx = o.b JOIN vert vc ON vc.vidx = o.c)""")  # fmt: skip
q("ordered_union", """SELECT occ_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS names FROM (SELECT occ_id, list_transform(list_concat(list_transform(range(size % 4 + 1), lambda k: k * 2 % 5), list_transform(range(size % 7 + 1), lambda k: k * 3 % 5)), lambda x: 'm' || x) AS l FROM occ)""", OCC)
q("step_listing", "SELECT path FROM (SELECT '/in/' || occ_id || ['.stp', '.STEP', '.fbx', '.step.txt', '.Stp'][size % 5 + 1] AS path FROM occ) WHERE lower(path) LIKE '%.stp' OR lower(path) LIKE '%.step'", OCC)
q("texture_sources", """SELECT occ_id AS model_id, CASE WHEN size % 5 = 0 THEN 'own' || size WHEN (size % 3 = 0) = (size % 8 % 2 = 0) THEN 'f' || size % 8 END AS bytes, CASE WHEN size % 3 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime FROM occ""", OCC)

q("scene_ir_evidence", f"""SELECT count(*) AS instances, count(DISTINCT qualified_key) AS prototypes, count(*) FILTER (WHERE has AND (gen IS NOT NULL OR surf IS NOT NULL OR curv IS NOT NULL)) AS shape_color_occurrences, count(*) FILTER (WHERE has AND mat) AS shape_material_occurrences,
  CAST(sum({_FACES.format('g0 IS NOT NULL', 'g1 IS NOT NULL')}) AS BIGINT) AS face_color_entries, CAST(sum({_FACES.format('m0', 'm1')}) AS BIGINT) AS face_material_entries, count(*) FILTER (WHERE size % 6 = 0) AS metadata_occurrences FROM looks""", APP)
q("export_materials", """SELECT 'high/' || geometry_key || '.glb' AS glb, count(*) AS occurrences, count(*) FILTER (size % 6 <> 5) AS exported_materials, count(*) FILTER (size % 6 <> 5 AND size % 10 <> 0 AND size % 4 IN (1, 3)) AS alpha_blend_materials,
  count(*) FILTER (size % 6 <> 5 AND size % 10 <> 0 AND size % 4 = 2) AS alpha_mask_materials, CASE WHEN sum(CASE WHEN size % 9 = 0 THEN 0 ELSE triangles END) > 0 THEN 'ok' ELSE 'error' END AS status FROM occ GROUP BY geometry_key""", OCC)
q("input_statistics", """SELECT (SELECT count(DISTINCT geometry_key) FROM occ) AS meshes, (SELECT count(*) FROM same) AS materials_input, (SELECT count(DISTINCT t) FROM same) AS materials_canonical, (SELECT count(*) FROM same WHERE t <> occ_id) AS material_slots_remapped,
  (SELECT count(DISTINCT (material, mode, has_normals, has_texcoord, CASE WHEN mode = 4 THEN -1 ELSE prim_id END)) FROM prim) AS primitives_merged_out, (SELECT count(*) FROM tri WHERE a >= nv OR b >= nv OR c >= nv) AS triangles_with_unknown_vertices,
  CAST(0 AS BIGINT) AS primitives_without_vertices, (SELECT CAST(sum((a >= nv)::INT + (b >= nv)::INT + (c >= nv)::INT) AS BIGINT) FROM tri) AS corners_without_remap""",
  f"{TRI}, {PRIM}, same AS (SELECT occ_id, min(occ_id) OVER (PARTITION BY round(CAST(size AS DOUBLE) / 7 * 1024), round(CAST(size AS DOUBLE) / 50 * 1024)) AS t FROM occ)")
q("solid_retarget_whole", "SELECT rec_no, CASE WHEN m = 9 AND rec_no BETWEEN 1 AND 100 THEN regexp_replace(norm, '([(,])#\\d+', '\\1#7', 'g') ELSE text END AS text FROM cls", REC)
_STUBBED = "(m = 2 AND entity_id BETWEEN 20 AND 90)"
q("face_range_stub_whole", f"SELECT rec_no, CASE WHEN {_STUBBED} THEN '#' || entity_id || '=COMPLEX_TRIANGULATED_FACE('''',#14338,3,((0.,0.,0.)),$,(1,2,3),(),((1)));' ELSE text END AS text, coalesce({_STUBBED}, false) AS stubbed FROM cls", REC)
q("triangle_order", "SELECT prim_id, count(*) AS triangles, true AS whole, true AS no_worse, CAST(sum(a + b * 3 + c * 7) AS BIGINT) AS corner_sum FROM ok WHERE a <> b AND b <> c AND a <> c GROUP BY 1", TRI)
q("geometry_examples", "SELECT prim_id, count(*) AS positions, least(count(*), 16) AS sampled FROM vert GROUP BY 1 ORDER BY 1 LIMIT 10", VERT)
