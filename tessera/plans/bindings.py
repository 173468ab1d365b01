"""The standard tables seen as scenes: items, prototypes, vertices, triangles, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal out a table of fewer files than cores; larger tables are read as they lie.

    ``by`` names columns of many values: without any, Spark sorts rows to deal them out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if len(df.inputFiles()) < cores else df


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, box, triangles, part: an order line is an occurrence of its part.

    The id is built from the line's natural key, row by row, so no sort numbers
    the lines.
    """
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    id_ = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    c = {"x": F.col("l_extendedprice") / 1000.0, "y": F.col("l_quantity").cast("double"), "z": days / 50.0}
    h = {a: F.col("p_size").cast("double") * F.lit(k) for a, k in zip(g.AXES, (0.01, 0.02, 0.005), strict=True)}
    box = g.box(*[c[a] - h[a] for a in g.AXES], *[c[a] + h[a] for a in g.AXES])
    return spread(line, "l_orderkey", "l_linenumber").join(part, F.col("l_partkey") == F.col("p_partkey")).select(id_.alias("id"), box.alias("box"), (F.col("p_size").cast("long") * 24).alias("triangles"), F.col("p_partkey").alias("part"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """occ_id, source_label, geometry_key, material_key, explicit, triangles: a part is an occurrence."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("occ_id"),
        F.col("p_name").alias("source_label"),
        F.col("p_brand").alias("geometry_key"),
        F.col("p_type").alias("material_key"),
        (F.col("p_size") % 5 == 0).alias("from_explicit"),
        (F.col("p_size").cast("long") * 24).alias("triangles"),
        F.col("p_size").cast("long").alias("size"),
    )


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prim_id, vidx, x y z, nx ny nz, u v from the first eight components of embeddings."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    names = ("x", "y", "z", "nx", "ny", "nz", "u", "v")
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("prim_id"), F.col("vec_id").alias("vidx"), *[F.element_at(e, i + 1).alias(n) for i, n in enumerate(names)])


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prim_id, tidx, a, b, c from events; some are degenerate, some out of range."""
    n = read(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    t = read(spark, sf_dir, "events").select(F.col("event_id").alias("tidx")).crossJoin(F.broadcast(n))
    a, b, c = (F.col("tidx") * k % F.col("n") if k == 1 else (F.col("tidx") * k + s) % F.col("n") for k, s in ((1, 0), (7, 3), (13, 5)))
    b = F.when(F.col("tidx") % 10 == 0, a).otherwise(b)
    c = F.when(F.col("tidx") % 17 == 0, c + F.col("n")).otherwise(c)
    return t.select((F.col("tidx") % 10).alias("prim_id"), "tidx", a.alias("a"), b.alias("b"), c.alias("c"))


#: SQL of the records: each part is an entity whose kind follows from its key.
RECORDS = r"""
SELECT p_partkey AS rec_no, CASE p_partkey % 12
  WHEN 0 THEN concat('#', p_partkey, '=APPLIED_GROUP_ASSIGNMENT(#', p_partkey - 1, ',$);')
  WHEN 1 THEN concat('#', p_partkey, ' = APPLIED_GROUP_ASSIGNMENT( #', p_partkey - 1, ', (#', p_partkey + 2, ') );')
  WHEN 2 THEN concat('#', p_partkey, '=COMPLEX_TRIANGULATED_FACE('''',#5,3,((0.,0.,1.)),$,(1,2,3),(),((1)));')
  WHEN 3 THEN concat('#', p_partkey, '=TRIANGULATED_FACE('''',#5,3,((0.,0.,1.)),$,(1,2,3),((1,2,3)));')
  WHEN 4 THEN concat('#', p_partkey, '=SURFACE_STYLE_RENDERING_WITH_PROPERTIES(', CASE WHEN p_size % 2 = 0 THEN '$' ELSE '.NORMAL_SHADING.' END, ',#4,(#5));')
  WHEN 5 THEN concat('#', p_partkey, '=GROUP_RELATIONSHIP($,$,#', p_partkey - 4, ',#', p_partkey - 3, ');')
  WHEN 6 THEN concat('#', p_partkey, '=ITEM_DEFINED_TRANSFORMATION($,$,#', p_partkey - 2, ',#', p_partkey - 1, ');')
  WHEN 7 THEN concat('#', p_partkey, '=PRODUCT_DEFINITION_SHAPE($,$,#', p_partkey - 2, ');')
  WHEN 8 THEN concat('#', p_partkey, '=SURFACE_SIDE_STYLE('''',(#', p_partkey - 4, ',#', p_partkey - 16, ',#', p_partkey - 3, '));')
  WHEN 9 THEN concat('#', p_partkey, '=TESSELLATED_SOLID('''',(#', p_partkey - 7, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat(',#', p_partkey - 6) END, '));')
  WHEN 10 THEN concat('#', p_partkey, '=( REPRESENTATION_RELATIONSHIP($,$,#1,#2)  SHAPE_REPRESENTATION_RELATIONSHIP() );')
  ELSE concat('/* ', p_partkey, ' COLOUR_RGB */') END AS text
FROM (SELECT p_partkey + 24 AS p_partkey, p_size FROM part) AS p
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RECORDS.replace("FROM part", "FROM {part}"), part=read(spark, sf_dir, "part"))
