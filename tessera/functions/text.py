"""Keys, paths and exchange-text (Part 21) patterns as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Record kinds with a fix of their own, in the order in which they are tried (fixed values).
KINDS = ("GROUP", "APPLIED_GROUP_ASSIGNMENT", "GROUP_RELATIONSHIP", "ITEM_DEFINED_TRANSFORMATION", "PRODUCT_DEFINITION_SHAPE", "SURFACE_STYLE_RENDERING_WITH_PROPERTIES", "SURFACE_SIDE_STYLE", "COMPLEX_TRIANGULATED_FACE", "TESSELLATED_SOLID")

#: What the two container kinds may hold (fixed values).
MEMBERS = {
    "SURFACE_SIDE_STYLE": ("SURFACE_STYLE_FILL_AREA", "SURFACE_STYLE_BOUNDARY", "SURFACE_STYLE_SILHOUETTE", "SURFACE_STYLE_SEGMENTATION_CURVE", "SURFACE_STYLE_CONTROL_GRID", "SURFACE_STYLE_PARAMETER_LINE", "SURFACE_STYLE_RENDERING", "SURFACE_STYLE_RENDERING_WITH_PROPERTIES"),
    "TESSELLATED_SOLID": ("TESSELLATED_VERTEX", "TESSELLATED_EDGE", "TESSELLATED_FACE", "TRIANGULATED_FACE", "COMPLEX_TRIANGULATED_FACE", "CUBIC_BEZIER_TRIANGULATED_FACE"),
}

#: File suffix -> MIME type (fixed values).
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "bmp": "image/bmp"}


def collapse(s: Column) -> Column:
    """One space for each run of spaces, tabs and line ends; none at the edges."""
    return F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))


# -- records ------------------------------------------------------------------
#
# A record is ``#id = NAME(argument, argument, ...);`` or, if complex,
# ``#id = ( NAME(...) NAME(...) );``.  Its structure is read from a copy of the same
# length in which strings are blanked out, so that commas, brackets and references
# within strings are none.


def masked(s: Column) -> Column:
    """s with all that stands between quotes as underscores, at the same places."""
    pieces = F.transform(F.split(s, "'"), lambda x, i: F.when(i % 2 == 0, x).otherwise(F.repeat(F.lit("_"), F.length(x))))
    return F.when(s.contains("'"), F.array_join(pieces, "'")).otherwise(s)


def _before(s: Column, mark: str) -> Column:
    return F.trim(F.substring_index(s, mark, 1))


def _after(s: Column, mark: str) -> Column:
    """What follows the first ``mark``; null if there is none."""
    return F.get(F.split(s, f"[{mark}]", 2), F.lit(1))


def entity_id(s: Column) -> Column:
    """The number before the first equals sign, if that alone stands before it."""
    head = F.when(s.startswith("#") & s.contains("="), _before(s, "="))
    digits = F.substr(head, F.lit(2))
    return F.when(F.translate(digits, "0123456789", "") == "", digits.try_cast("bigint"))


def _name(m: Column) -> Column:
    """The type before the first bracket of a masked record; empty if complex or none."""
    name = F.trim(_after(_before(m, "("), "="))
    return F.when(m.contains("(") & _is_type(name), name).otherwise("")


def _is_type(name: Column) -> Column:
    return (name != "") & (F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", "") == "") & ~F.substr(name, F.lit(1), F.lit(1)).between("0", "9") & ~name.startswith("_")


def kind(s: Column) -> Column:
    """NON_ENTITY, one of KINDS, or UNKNOWN."""
    name = _name(masked(s))
    return F.when(entity_id(s).isNull(), "NON_ENTITY").when(name.isin(*KINDS), name).otherwise("UNKNOWN")


def entity_types(s: Column) -> Column:
    """The type of a simple entity, or all of a complex one."""
    m = masked(s)
    name, right = _name(m), F.translate(_after(m, "="), " ", "")
    # what stands before each bracket, back to the last bracket or comma
    opened = F.transform(F.split(right, r"\("), lambda x: F.substring_index(F.substring_index(x, ")", -1), ",", -1))
    several = F.filter(F.slice(opened, 1, F.size(opened) - 1), _is_type)
    complex_ = entity_id(s).isNotNull() & right.startswith("(") & right.endswith(");")
    return F.when(name != "", F.array(name)).when(complex_, F.array_distinct(several)).otherwise(F.array().cast("array<string>"))


def arguments(m: Column) -> Column:
    """Of a masked simple record, what stands between its outer brackets, without
    blanks; null if it does not end with a bracket and a semicolon."""
    bare = F.translate(m, " ", "")
    inner = _after(bare, "(")
    return F.when(inner.endswith(");"), F.substr(inner, F.lit(1), F.length(inner) - 2))


def _is_ref(x: Column) -> Column:
    return x.startswith("#") & (F.length(x) > 1) & (F.translate(F.substr(x, F.lit(2)), "0123456789", "") == "")


def refs(s: Column) -> Column:
    """The numbers after # in a text."""
    parts = F.split(s, "#")

    def leading(x: Column) -> Column:
        return F.substr(x, F.lit(1), F.length(x) - F.length(F.ltrim(x, F.lit("0123456789")))).try_cast("bigint")

    numbers = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), leading)
    return F.filter(numbers, lambda x: x.isNotNull())


def _members(m: Column) -> Column:
    """The list of a container ``NAME(name,(member, ...));``, without its brackets; empty if it has another form."""
    inner = arguments(m)
    name, rest = _before(inner, ","), _after(inner, ",")
    named = (name == "$") | ((F.length(name) >= 2) & name.startswith("'") & name.endswith("'"))
    listed = _name(m).isin(*MEMBERS) & named & (F.length(rest) >= 2) & rest.startswith("(") & rest.endswith(")")
    return F.when(listed, F.substr(rest, F.lit(2), F.length(rest) - 2)).otherwise("")


def container_refs(s: Column) -> Column:
    return refs(_members(masked(s)))


def container_name(s: Column) -> Column:
    """A container's first argument as it is written."""
    m = masked(s)
    first = F.instr(m, "(") + 1
    return F.when(_members(m) != "", F.trim(F.substr(s, first, F.instr(m, ",") - first))).otherwise("")


def broken(s: Column, k: Column) -> Column:
    """Records that are wrong in themselves: assignments of nothing, faces with an
    empty strip before another argument, renderings whose method is no name
    between dots."""
    inner = F.coalesce(arguments(masked(s)), F.lit(""))
    part = F.split(inner, ",")
    first, method = F.get(part, F.lit(0)), F.when(F.size(part) > 1, F.get(part, F.lit(0))).otherwise("")
    nothing = (F.size(part) == 2) & _is_ref(first) & (F.get(part, F.lit(1)) == "$")
    dotted = (F.length(method) > 2) & method.startswith(".") & method.endswith(".")
    return (
        ((k == "APPLIED_GROUP_ASSIGNMENT") & nothing)
        | ((k == "COMPLEX_TRIANGULATED_FACE") & inner.contains(",(),"))
        | ((k == "SURFACE_STYLE_RENDERING_WITH_PROPERTIES") & (method != "") & ~dotted)
    )


def _unset(s: Column, n: int) -> Column:
    """The arguments after the first ``n``, if these are all ``$``; else null."""
    part = F.split(_after(s, "("), ",", n + 1)
    dollars = F.forall(F.slice(part, 1, n), lambda x: F.trim(x) == "$")
    return F.when((F.size(part) == n + 1) & dollars & F.rtrim(s).endswith(";"), F.get(part, F.lit(n)))


def _named(s: Column, empty: str, rest: Column) -> Column:
    return F.concat(F.substring_index(s, "(", 1), F.lit("(" + empty), rest)


def patched(s: Column, k: Column) -> Column:
    """The record with its missing names filled in; null if none is missing."""
    mark = "REPRESENTATION_RELATIONSHIP"
    pieces = F.split(s, mark)

    def filled(x: Column, i: Column) -> Column:
        unset = (i > 0) & F.ltrim(x).startswith("(") & (F.trim(_before(_after(x, "("), ",")) == "$") & x.contains(",")
        return F.when(unset, F.concat(F.lit("('',"), _after(x, ","))).otherwise(x)

    anywhere = F.when(s.contains("($,") & s.contains(mark), F.array_join(F.transform(pieces, filled), mark)).otherwise(s)
    one, two = _unset(s, 1), _unset(s, 2)
    return (
        F.when((k == "GROUP_RELATIONSHIP") & two.isNotNull(), _named(s, "'','',", two))
        .when((k == "ITEM_DEFINED_TRANSFORMATION") & one.isNotNull(), _named(s, "'',", F.ltrim(one)))
        .when(anywhere != s, anywhere)
        .when((k == "PRODUCT_DEFINITION_SHAPE") & one.isNotNull(), _named(s, "'',", F.ltrim(one)))
    )


def uses(s: Column, *names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | s.contains(n)
    return out


def has_suffix(path: Column, *suffixes: str) -> Column:
    out = F.lit(False)
    for x in suffixes:
        out = out | F.lower(path).endswith(x)
    return out


def mime(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = None
    for k, v in MIME.items():
        out = F.when(suffix == k, v) if out is None else out.when(suffix == k, v)
    return out.otherwise("application/octet-stream")


def join_uri(base: Column, name: Column) -> Column:
    """One slash between the two, none before ``name`` where ``base`` is empty."""
    return F.when(base == "", name).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(name, "^/+", "")))


def geometry_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def qualified_key(geometry: Column, material: Column) -> Column:
    return F.concat(geometry, F.lit("|mat:"), material)


def node_path(parent: Column, child: Column, slot: Column) -> Column:
    return F.concat(parent, F.lit("/"), child, F.lit("#mesh_"), slot.cast("string"))


def batch_table(metadata: Column) -> Column:
    """{"key": ["value"]} in the order of the keys."""
    entries = F.array_sort(F.map_entries(metadata))
    return F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.array(e["value"]).alias("value")))))
