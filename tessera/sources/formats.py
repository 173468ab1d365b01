"""Which reader a path takes, and readers of text, JSON and binary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import has_suffix, mime
from tessera.operators.exchange_text import split_lines
from tessera.operators.scene import scene_evidence

STEP_SUFFIXES = (".stp", ".step")

#: What every importer's occurrences must have (name -> type).
OCCURRENCE_CONTRACT = {"occ_id": "bigint", "source_label": "string", "geometry_key": "string", "material_key": "string", "from_explicit": "boolean", "triangles": "bigint"}


def route(path: Column, wanted: Column) -> Column:
    """The importer of a path: the one asked for; ``auto`` goes by suffix, with
    STEP as the last resort (which is how folders are read)."""
    return F.when(wanted.isin("step", "fbx"), wanted).when(has_suffix(path, ".fbx"), "fbx").otherwise("step")


def require(df: DataFrame, contract: dict[str, str] | None = None) -> DataFrame:
    """df, if it has the columns of a contract; else ValueError."""
    have = dict(df.dtypes)
    wrong = {k: (v, have.get(k)) for k, v in (contract or OCCURRENCE_CONTRACT).items() if have.get(k) != v}
    if wrong:
        raise ValueError(f"columns that differ from the contract: {wrong}")
    return df


def step_files(spark: SparkSession, path: str) -> DataFrame:
    """Exchange files of a folder (not below it), or one file, sorted by path; none
    where nothing is there.  Contents are not read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, length long")
    return files.filter(has_suffix(F.col("path"), *STEP_SUFFIXES)).select("path", "length").orderBy("path")


def step_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec_no, text) of exchange files; a file's lines are kept in order.

    Large files are read in blocks: a line's place is its block's and, within it,
    the order of reading.  Empty lines are left out.
    """
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(path).select(*where, F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return split_lines(lines.filter("line <> ''"))


def write_records(records: DataFrame, path: str) -> None:
    """Records in order as text files."""
    records.repartitionByRange("rec_no").sortWithinPartitions("rec_no").select(F.col("text").alias("value")).write.text(path)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped, a missing file has no rows."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def scene_occurrences(spark: SparkSession, path: str) -> DataFrame:
    """Occurrences of JSON-lines files in any store that Spark reads, as the contract
    has them: no mark is no explicit reference, no number no triangles."""
    schema = ", ".join(f"{k} {v}" for k, v in OCCURRENCE_CONTRACT.items())
    rows = json_rows(spark, path, schema)
    return require(rows.withColumn("from_explicit", F.coalesce("from_explicit", F.lit(False))).withColumn("triangles", F.coalesce("triangles", F.lit(0).cast("long"))))


def textures(models: DataFrame, files: DataFrame) -> DataFrame:
    """Texture bytes of models (model_id, folder, texture, embedded): embedded ones,
    else those of a file (absolute, or next to the model), else null; with MIME type."""
    name = F.replace("texture", F.lit("\\"), F.lit("/"))
    at = F.when(name.startswith("/"), name).otherwise(F.concat(F.col("folder"), F.lit("/"), name))
    wanted = models.withColumn("_at", F.when(F.col("embedded").isNull(), at))
    found = files.select(F.regexp_replace("path", "^file:/*", "/").alias("_at"), "content")
    return wanted.join(found, "_at", "left").select("model_id", F.coalesce("embedded", "content").alias("bytes"), mime(F.col("texture")).alias("mime"))


def tileset_rows(spark: SparkSession, path: str, max_depth: int = 6) -> DataFrame:
    """Tiles of a tileset.json down to a depth: path of child numbers, error, uri, box."""
    text = spark.read.text(path, wholetext=True)
    level = text.select(F.lit("").alias("path"), F.lit(0).alias("depth"), F.get_json_object("value", "$.root").alias("node"))
    out = None
    for d in range(max_depth + 1):
        rows = level.select("path", "depth", F.get_json_object("node", "$.geometricError").cast("double").alias("error"), F.get_json_object("node", "$.content.uri").alias("uri"), F.from_json(F.get_json_object("node", "$.boundingVolume.box"), "array<double>").alias("box"))
        out = rows if out is None else out.unionByName(rows)
        children = F.from_json(F.get_json_object("node", "$.children"), "array<string>")
        level = level.select("path", F.posexplode(children).alias("k", "node")).select(F.concat_ws("/", F.nullif("path", F.lit("")), F.col("k").cast("string")).alias("path"), F.lit(d + 1).alias("depth"), "node")
    return out


def write_evidence(evidence: DataFrame, occurrences: DataFrame, folder: str) -> None:
    """Evidence of an import as JSON: ``import_evidence`` and ``scene_ir_evidence`` (one
    row each), and a row per occurrence (label, source_faces, has_metadata, has_appearance)."""
    evidence.coalesce(1).write.mode("overwrite").json(f"{folder}/import_evidence")
    scene_evidence(evidence).coalesce(1).write.mode("overwrite").json(f"{folder}/scene_ir_evidence")
    rows = occurrences.select(F.col("source_label").alias("label"), F.col("face_count").alias("source_faces"), "has_metadata", F.col("appearance").isNotNull().alias("has_appearance"))
    rows.write.mode("overwrite").json(f"{folder}/occurrence_evidence")


def append_export_evidence(rows: DataFrame, folder: str) -> None:
    """Adds rows of ``scene.export_evidence`` to those of earlier exports."""
    rows.write.mode("append").json(f"{folder}/export_evidence")


def write_shards(texts: DataFrame, total: int, n: int, source: str, path: str) -> None:
    """Shards (shard, entities, text) as text files, one folder each, and a manifest:
    what was cut into how many, and the entities of each shard."""
    texts.select(F.format_string("%02d", "shard").alias("shard"), F.substr(F.col("text"), F.lit(1), F.length("text") - 1).alias("value")).write.partitionBy("shard").text(path)
    spark = texts.sparkSession
    head = spark.createDataFrame([(source, total, n, total // n, total % n)], "input string, total_entities long, num_shards int, base long, remainder long")
    each = texts.agg(F.sort_array(F.collect_list(F.struct("shard", "entities"))).alias("shards"))
    head.crossJoin(each).coalesce(1).write.json(f"{path}_manifest")
