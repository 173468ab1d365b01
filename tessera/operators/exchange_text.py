"""Cleaning of CAD-exchange text (Part 21): records, removals, patches, shards.

records: rec_no, text.  Containers lose references to removed, unknown and
unsuitable entities; one that loses all goes too, until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.storage import written


#: Lines that are counted in one task, where a file has no blocks of its own.
BLOCK_LINES = 1 << 16


def _running(lines: DataFrame, flag: str, name: str, last: int) -> DataFrame:
    """The sum of ``flag`` over a file's lines up to this one (last 0) or the one before
    (-1): within its block, plus that of the blocks before."""
    within = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, last)
    total = lines.groupBy("file", "block").agg(F.sum(flag).alias("_t"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    start = total.select("file", "block", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    return lines.withColumn(name, F.coalesce(F.sum(flag).over(within), F.lit(0))).join(start, ["file", "block"]).withColumn(name, F.col(name) + F.col("_b")).drop("_b")


def split_lines(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, line) to records (file, rec_no, text).

    A record begins at a line that starts with # (after blanks) unless one is
    open, and ends at the line in which a semicolon stands; other lines stand for
    themselves.  What is left open at the end is kept.  Files are handled in blocks,
    so no task holds a file: by a column ``block``, where line numbers grow with
    the blocks and within each, else by ``BLOCK_LINES`` line numbers.
    """
    x = lines if "block" in lines.columns else lines.withColumn("block", F.floor(F.col("line_no") / BLOCK_LINES))
    x = x.withColumn("_stop", F.col("line").contains(";").cast("int")).withColumn("_begin", F.ltrim(F.col("line")).startswith("#").cast("int"))
    # an open record is closed by the first line with a semicolon, whatever starts between
    x = _running(x, "_stop", "_closed", -1)
    part = Window.partitionBy("file", "_closed").orderBy("block", "line_no")
    opened = F.max("_begin").over(part.rowsBetween(Window.unboundedPreceding, 0))
    first = F.coalesce(F.max("_begin").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.select("file", "block", "line_no", "line", F.when((opened == 1) & (first == 1), 0).otherwise(1).alias("_new"))
    x = _running(written(x, "lines"), "_new", "rec_no", 0)
    rows = x.groupBy("file", "rec_no").agg(F.sort_array(F.collect_list(F.struct("block", "line_no", "line"))).alias("l"))
    return rows.select("file", "rec_no", F.array_join(F.transform("l", lambda r: r["line"]), "\n").alias("text"))


def classify(records: DataFrame) -> DataFrame:
    """entity_id, kind, types, refs (of containers), name, norm of each record."""
    r = records.withColumn("norm", t.collapse(F.col("text"))).withColumn("kind", t.kind(F.col("norm")))
    entity = F.col("kind") != "NON_ENTITY"
    return r.select(
        "rec_no",
        "text",
        "norm",
        "kind",
        F.when(entity, t.entity_id(F.col("norm"))).alias("entity_id"),
        F.when(entity, t.entity_types(F.col("norm"))).alias("types"),
        F.when(F.col("kind").isin(*t.MEMBERS), t.container_refs(F.col("norm"))).alias("refs"),
        F.when(F.col("kind").isin(*t.MEMBERS), t.container_name(F.col("norm"))).alias("name"),
    )


def reference_list(classified: DataFrame) -> DataFrame:
    """(rec_no, entity_id, k, ref) of containers."""
    return classified.filter("refs is not null").select("rec_no", "entity_id", "kind", F.posexplode("refs").alias("k", "ref"))


def _allowed(classified: DataFrame) -> DataFrame:
    """References of containers whose target may stand there (the last of several
    records with an id says what it is)."""
    last = classified.filter("entity_id is not null").groupBy("entity_id").agg(F.max_by("types", "rec_no").alias("_types"))
    known = last.select(F.col("entity_id").alias("_id"), "_types")
    found = reference_list(classified).join(known, F.col("ref") == F.col("_id"), "left").drop("_id")
    fits = F.lit(False)
    for kind, members in t.MEMBERS.items():
        fits = fits | ((F.col("kind") == kind) & F.arrays_overlap("_types", F.array(*[F.lit(m) for m in members])))
    return found.withColumn("known", F.col("_types").isNotNull()).withColumn("fits", F.coalesce(fits, F.lit(False))).drop("_types")


def removed(classified: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(rec_no, entity_id, round) of all records that go: round 0 are broken in
    themselves, later ones containers that had lost all references by then.

    Ids, not records, are removed, as references see ids.  Nesting is shallow, so
    rounds are few; each is written to the shared folder.
    """
    e = classified.filter("entity_id is not null")
    gone = written(e.filter(t.broken(F.col("norm"), F.col("kind"))).select("rec_no", "entity_id", F.lit(0).alias("round")), "removed")
    use = written(_allowed(classified).filter("fits").select("rec_no", "ref"), "references")
    holders = e.filter(F.col("kind").isin(*t.MEMBERS)).select("rec_no", "entity_id")
    for n in range(1, most_rounds):
        live = use.join(gone.select(F.col("entity_id").alias("ref")).distinct(), "ref", "left_anti").select("rec_no").distinct()
        more = holders.join(gone.select("rec_no"), "rec_no", "left_anti").join(live, "rec_no", "left_anti")
        more = written(more.select("rec_no", "entity_id", F.lit(n).alias("round")), "removed")
        if more.isEmpty():
            return gone
        gone = gone.unionByName(more)
    raise RuntimeError("containers nest too deeply")


def sanitize(classified: DataFrame) -> DataFrame:
    """(rec_no, text, action): what is left, patched, filtered or as it was."""
    gone = removed(classified)
    ids = gone.select(F.col("entity_id").alias("_gone")).distinct()
    live = _allowed(classified).join(ids, F.col("ref") == F.col("_gone"), "left_anti").filter("fits")
    refs = live.groupBy("rec_no").agg(F.sort_array(F.collect_list(F.struct("k", "ref"))).alias("_live"))
    left = classified.join(gone.select("rec_no"), "rec_no", "left_anti").join(refs, "rec_no", "left")
    kept = F.coalesce(F.col("_live"), F.array())
    joined = F.array_join(F.transform("_live", lambda x: F.concat(F.lit("#"), x["ref"].cast("string"))), ",")
    fewer = F.col("kind").isin(*t.MEMBERS) & (F.size(kept) != F.size("refs"))
    rewritten = F.concat(F.lit("#"), F.col("entity_id").cast("string"), F.lit("="), F.col("kind"), F.lit("("), F.col("name"), F.lit(",("), joined, F.lit("));"))
    patch = t.patched(F.col("norm"), F.col("kind"))
    entity = F.col("kind") != "NON_ENTITY"
    text = F.when(entity & patch.isNotNull(), patch).when(fewer, rewritten).when(F.col("kind").isin(*t.MEMBERS), F.col("norm")).otherwise(F.col("text"))
    action = F.when(entity & patch.isNotNull(), "patched").when(fewer, "filtered").otherwise("kept")
    return left.select("rec_no", text.alias("text"), action.alias("action"))


def statistics(classified: DataFrame) -> DataFrame:
    """One row of counts."""
    k = F.col("kind")
    bad = t.broken(F.col("norm"), k)
    return classified.agg(
        F.count("*").alias("records"),
        F.count("entity_id").alias("entities"),
        F.count_if(bad & (k == "APPLIED_GROUP_ASSIGNMENT")).alias("empty_assignments"),
        F.count_if(bad & (k == "COMPLEX_TRIANGULATED_FACE")).alias("empty_strips"),
        F.count_if(bad & (k == "SURFACE_STYLE_RENDERING_WITH_PROPERTIES")).alias("bad_renderings"),
        F.count_if((k != "NON_ENTITY") & t.patched(F.col("norm"), k).isNotNull()).alias("patchable"),
        F.bool_or(t.uses(F.col("text"), "COLOUR", "COLOR")).alias("has_colors"),
        F.bool_or(t.uses(F.col("text"), "MATERIAL")).alias("has_materials"),
    )


def shards(classified: DataFrame, n: int) -> DataFrame:
    """(rec_no, entity_id, shard): entities in order, in ``n`` even runs; the first
    ones take what is left over."""
    from tessera.operators.ids import dense_ids

    e = dense_ids(classified.filter("entity_id is not null").select("rec_no", "entity_id"), ["rec_no"], "_i")
    total = e.agg(F.count("*").alias("_n"))
    base, rest = F.floor(F.col("_n") / n), F.col("_n") % n
    big = rest * (base + 1)
    shard = F.when(F.col("_i") < big, F.floor(F.col("_i") / (base + 1))).otherwise(rest + F.floor((F.col("_i") - big) / F.greatest(base, F.lit(1))))
    return e.crossJoin(F.broadcast(total)).select("rec_no", "entity_id", shard.cast("int").alias("shard"))


def integrity(original: DataFrame, sharded: DataFrame) -> DataFrame:
    """Ids that only one side has: empty if no shard lost or made one."""
    a, b = original.select("entity_id"), sharded.select("entity_id")
    return a.exceptAll(b).withColumn("side", F.lit("lost")).unionByName(b.exceptAll(a).withColumn("side", F.lit("made")))


def stub_range(classified: DataFrame, kind: str, low: int, high: int, stub: str) -> DataFrame:
    """Entities of a kind with ids in a range get the payload ``stub``."""
    hit = (F.col("kind") == kind) & F.col("entity_id").between(low, high)
    return classified.select("rec_no", F.when(hit, F.concat(F.lit("#"), F.col("entity_id").cast("string"), F.lit("="), F.lit(stub))).otherwise(F.col("text")).alias("text"), hit.alias("stubbed"))


def retarget(classified: DataFrame, low: int, high: int, target: int) -> DataFrame:
    """References of solids with ids in a range point to ``target``."""
    hit = (F.col("kind") == "TESSELLATED_SOLID") & F.col("entity_id").between(low, high)
    new = F.regexp_replace("norm", r"(?<=[(,])\s*#\d+", f"#{target}")
    return classified.select("rec_no", F.when(hit, new).otherwise(F.col("text")).alias("text"))


def id_ranges(classified: DataFrame, kind: str, width: int) -> DataFrame:
    """First, last and number of a kind's ids, per run of ``width`` ids."""
    low = classified.filter(F.col("kind") == kind).agg(F.min("entity_id").alias("_low"))
    e = classified.filter(F.col("kind") == kind).crossJoin(F.broadcast(low))
    return e.groupBy(F.floor((F.col("entity_id") - F.col("_low")) / width).cast("long").alias("run")).agg(F.min("entity_id").alias("first_id"), F.max("entity_id").alias("last_id"), F.count("*").alias("n"))


def cleaning_statistics(classified: DataFrame) -> DataFrame:
    """One row: what ``sanitize`` removes, patches, filters and skips."""
    gone = removed(classified)
    kinds = gone.join(classified.select("rec_no", "kind"), "rec_no")

    def lost(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    one = kinds.agg(
        lost("APPLIED_GROUP_ASSIGNMENT").alias("removed_assignments"),
        lost("COMPLEX_TRIANGULATED_FACE").alias("removed_faces"),
        lost("SURFACE_STYLE_RENDERING_WITH_PROPERTIES").alias("removed_renderings"),
        lost("SURFACE_SIDE_STYLE").alias("removed_side_styles"),
        lost("TESSELLATED_SOLID").alias("removed_solids"),
        F.count_distinct("entity_id").alias("removed_ids"),
    )
    left = classified.join(gone.select("rec_no"), "rec_no", "left_anti")
    k, patch = F.col("kind"), t.patched(F.col("norm"), F.col("kind"))
    named = k.isin("GROUP_RELATIONSHIP", "ITEM_DEFINED_TRANSFORMATION", "PRODUCT_DEFINITION_SHAPE")
    hit = patch.isNotNull() & (k != "NON_ENTITY")
    two = left.agg(
        *[F.count_if(hit & (k == x)).alias(f"patched_{n}") for x, n in (("GROUP_RELATIONSHIP", "groups"), ("ITEM_DEFINED_TRANSFORMATION", "transformations"), ("PRODUCT_DEFINITION_SHAPE", "shapes"))],
        F.count_if(hit & ~named).alias("patched_relationships"),
    )
    # a reference is skipped as removed, as unknown or as of an unsuitable type
    ids = gone.select(F.col("entity_id").alias("_gone")).distinct()
    use = _allowed(classified).join(ids, F.col("ref") == F.col("_gone"), "left")
    why = F.when(F.col("_gone").isNotNull(), "removed").when(~F.col("known"), "unknown").when(~F.col("fits"), "unsuitable")
    use = use.withColumn("_why", why)
    short = {"SURFACE_SIDE_STYLE": "side_style", "TESSELLATED_SOLID": "solid"}
    three = use.agg(*[F.count_if((k == kind) & (F.col("_why") == w)).alias(f"{w}_{n}_refs") for kind, n in short.items() for w in ("removed", "unknown", "unsuitable")])
    live = use.join(gone.select("rec_no"), "rec_no", "left_anti").filter("_why is not null").select("rec_no", "kind").distinct()
    four = live.agg(*[F.count_if(k == kind).alias(f"filtered_{n}s") for kind, n in short.items()])
    colored, solid = (t.uses(F.col("text"), *x) for x in (("COLOUR", "COLOR"), ("MATERIAL",)))
    five = classified.agg(F.count("*").alias("records"), F.count_if(colored).alias("color_hits"), F.count_if(solid).alias("material_hits"))
    out = one.crossJoin(two).crossJoin(three).crossJoin(four).crossJoin(five)
    return out.withColumn("has_colors", F.col("color_hits") > 0).withColumn("has_materials", F.col("material_hits") > 0)


def shard_texts(classified: DataFrame, n: int) -> DataFrame:
    """(shard, entities, text): each shard as a whole file, all with the records before
    the first entity as head and those after the last one as foot.

    A shard's text is one row, so ``n`` is chosen to keep files in memory.
    """
    ends = classified.filter("entity_id is not null").agg(F.min("rec_no").alias("_first"), F.max("rec_no").alias("_last"))
    numbered = spread_shards(n, classified.sparkSession)
    other = classified.filter("entity_id is null").crossJoin(F.broadcast(ends))
    edge = other.filter("_first is null or rec_no < _first or rec_no > _last").select("rec_no", "text").crossJoin(F.broadcast(numbered))
    own = shards(classified, n).join(classified.select("rec_no", "text"), "rec_no").select("rec_no", "text", "shard", F.lit(1).alias("_e"))
    rows = own.unionByName(edge.withColumn("_e", F.lit(0)))
    per = rows.groupBy("shard").agg(F.sum("_e").cast("long").alias("entities"), F.sort_array(F.collect_list(F.struct("rec_no", "text"))).alias("_t"))
    return per.select("shard", "entities", F.concat(F.array_join(F.transform("_t", lambda x: x["text"]), "\n"), F.lit("\n")).alias("text"))


def spread_shards(n: int, spark: SparkSession) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("shard"))


def sorted_ids(classified: DataFrame, kind: str) -> DataFrame:
    """The ids of a kind, each once, in order."""
    return classified.filter(F.col("kind") == kind).select("entity_id").distinct().orderBy("entity_id")
