"""Readers of annotation and prediction files, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "image_id string, bounds array<double>, crs string, width int, height int, coco_annotations string, biome int, biome_name string, country string"
ANNOTATION = "array<struct<id: bigint, image_id: string, category_id: int, bbox: array<double>, segmentation: string, iscrowd: int>>"
BOX = "image_path string, xmin int, ymin int, xmax int, ymax int, label string"


def read_tile_meta(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all ``*_meta.json`` under path, except below folders named archive. Annotations may be a list or a string
    that holds one; anything else is none. Missing ids and biomes get ``unknown`` and ``Unknown``."""
    raw = spark.read.schema(META).option("recursiveFileLookup", True).option("pathGlobFilter", "*_meta.json").option("multiLine", True).json(path)
    raw = raw.withColumn("path", F.col("_metadata.file_path")).where(~F.col("path").contains("archive"))
    found = F.coalesce(F.from_json("coco_annotations", ANNOTATION), F.array().cast(ANNOTATION))
    return raw.withColumns({"image_id": F.coalesce("image_id", F.lit("unknown")), "biome_name": F.coalesce("biome_name", F.lit("Unknown")), "annotations": found}).drop("coco_annotations")


def annotation_boxes(meta: DataFrame) -> DataFrame:
    """image_id, category and box of annotations that have one as x, y, w, h, else the bounds of their first ring."""
    a = meta.select("image_id", F.explode("annotations").alias("a")).select("image_id", F.col("a.category_id").alias("category"), "a.bbox", F.from_json("a.segmentation", "array<array<double>>").alias("rings"))
    ring = F.col("rings")[0]
    xs, ys = F.filter(ring, lambda v, k: k % 2 == 0), F.filter(ring, lambda v, k: k % 2 == 1)
    given = F.size("bbox") == 4
    side = lambda k, own: F.when(given, own).otherwise(k).cast("int")
    b = F.col("bbox")
    return a.select(
        "image_id", "category", side(F.array_min(xs), b[0]).alias("xmin"), side(F.array_min(ys), b[1]).alias("ymin"), side(F.array_max(xs), b[0] + b[2]).alias("xmax"), side(F.array_max(ys), b[1] + b[3]).alias("ymax")
    ).where("xmin is not null")


def read_box_csv(spark: SparkSession, path: str, optional: str = "shadow_angle double, shadow_x double, shadow_y double, domain string") -> DataFrame:
    """Boxes of CSV files with a header each; files may differ in the order of their columns and in what they have: a column
    that a file lacks is null, one that isn't known is left out. Values that aren't of their column's kind are null."""
    kinds = {c.split()[0]: c.split()[1] for c in f"{BOX}, {optional}".split(", ")}
    line = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    heads = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", line.alias("at")).groupBy("file").agg(F.min_by("value", "at").alias("head"))
    # a row for each layout; the reader takes lists of files
    plain = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))
    layouts = heads.groupBy("head").agg(F.collect_list(plain).alias("files")).orderBy("head").collect()
    parts = []
    for r in layouts:
        have = spark.read.option("header", True).csv(r["files"])
        parts.append(have.select(*[(F.col(c).try_cast(k) if c in have.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()]))
    out = spark.createDataFrame([], f"{BOX}, {optional}")
    for p in parts:
        out = out.unionByName(p)
    return out


def read_azimuth_csv(spark: SparkSession, path: str) -> DataFrame:
    """filename, shadow_azimuth of lines that aren't skipped (a blank mark is none); of a repeated file the last line."""
    lines = spark.read.option("header", True).schema("filename string, shadow_azimuth double, skipped string").csv(path)
    # a file's later blocks hold later lines, and a block's rows are numbered in order
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = lines.select("*", at.alias("at")).where(F.coalesce(F.lower("skipped"), F.lit("")) != "true")
    return lines.groupBy("filename").agg(F.max_by("shadow_azimuth", "at").alias("shadow_azimuth"))


def read_voc_boxes(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Boxes of VOC XML files, one row for each object; coordinates are cut to whole numbers."""
    kind = "object array<struct<name: string, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
    raw = spark.read.format("xml").option("rowTag", "annotation").schema(kind).load(path)
    rows = raw.select(F.col("_metadata.file_name").alias("file"), F.explode("object").alias("o"))
    out = rows.select("file", F.col("o.name").alias("name"), *[F.col(f"o.bndbox.{c}").cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    return out if name is None else out.where(F.col("name") == name)


FEATURES = "features array<struct<properties: string, geometry: string>>, crs string"


def _polygons(g):
    """The polygons of a geometry in VARIANT; a geometry of another type has none."""
    one, many = F.try_variant_get(g, "$.coordinates", "array<array<array<double>>>"), F.try_variant_get(g, "$.coordinates", "array<array<array<array<double>>>>")
    kind = F.try_variant_get(g, "$.type", "string")
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)


def read_predictions_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row for each polygon of each feature: file, tree_id, score (the first there is of deepforest_score, score,
    Confidence and confidence, else 1.0), bbox, part (from 0) and ring, the polygon's first. A MultiPolygon has a row a
    part, a GeometryCollection one for each part of its polygons. A feature without polygons, of another type or with a
    geometry that can't be read, has one row without ring. Files without features give no rows."""
    raw = spark.read.option("multiLine", True).schema(FEATURES).json(path).select(F.col("_metadata.file_name").alias("file"), F.explode("features").alias("f"))
    own = lambda name: F.get_json_object("f.properties", f"$.{name}")
    score = F.coalesce(*[own(c).try_cast("double") for c in ("deepforest_score", "score", "Confidence", "confidence")], F.lit(1.0))
    g = F.try_parse_json("f.geometry")
    held = F.try_variant_get(g, "$.geometries", "array<variant>")
    none = F.array().cast("array<array<array<array<double>>>>")
    parts = F.coalesce(_polygons(g), F.flatten(F.transform(held, lambda x: F.coalesce(_polygons(x), none))))
    rows = raw.select("file", own("tree_id").try_cast("bigint").alias("tree_id"), score.alias("score"), F.from_json(own("bbox"), "array<double>").alias("bbox"), F.filter(parts, lambda p: p.isNotNull() & (F.size(p) > 0)).alias("parts"))
    rows = rows.select("file", "tree_id", "score", "bbox", F.posexplode_outer("parts").alias("part", "polygon"))
    ring = F.transform(F.col("polygon")[0], lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    return rows.select("file", "tree_id", "score", "bbox", F.coalesce("part", F.lit(0)).alias("part"), ring.alias("ring"))


def read_detection_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Prediction_*.json: file, score (a missing one is 0), category_id and the columns of ``segmented``."""
    kind = "score double, category_id int, segmentation string"
    raw = spark.read.option("multiLine", True).option("pathGlobFilter", "Prediction_*.json").schema(kind).json(path)
    return segmented(raw.select(F.col("_metadata.file_name").alias("file"), F.coalesce("score", F.lit(0.0)).alias("score"), "category_id", "segmentation"))


def segmented(df: DataFrame, column: str = "segmentation") -> DataFrame:
    """df with a segmentation's JSON read as kind (``rings``, ``runs``, ``packed`` or ``unknown``), rings (points as x, y on
    end), runs (run lengths down the columns), packed (the same as a compressed string) and size (height, width)."""
    counts = F.get_json_object(column, "$.counts")
    rings = F.from_json(column, "array<array<double>>")
    listed, ringed = counts.startswith("["), F.col(column).startswith("[") & (F.size(rings) > 0) & F.coalesce(F.size(rings[0]) >= 6, F.lit(False))
    size = F.from_json(F.get_json_object(column, "$.size"), "array<int>")
    kind = F.when(ringed, "rings").when(listed & (F.size(size) == 2), "runs").when(counts.isNotNull() & (F.size(size) == 2), "packed").otherwise("unknown")
    out = df.withColumns({"kind": kind, "rings": rings, "runs": F.when(listed, F.from_json(counts, "array<int>")), "packed": F.when(~listed, counts), "size": size})
    own = {"rings": "rings", "runs": "runs", "packed": "packed"}
    return out.withColumns({c: F.when(F.col("kind") == k, F.col(c)) for c, k in own.items()} | {"size": F.when(F.col("kind").isin("runs", "packed"), F.col("size"))}).drop(column)


def list_images(spark: SparkSession, path: str, endings: tuple[str, ...] = ("tif", "tiff", "png", "jpg", "jpeg")) -> DataFrame:
    """path, length of the images below a folder; their bytes aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*endings))


def catalogue(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Chosen columns of a Parquet catalogue; image columns stay unread."""
    return spark.read.parquet(path).select(*columns)


def picked_sites(splits: list[DataFrame], column: str, part: str, n: int, seed: int = 1) -> DataFrame:
    """n rows of the splits' union whose column contains a text, in the order of a seeded hash."""
    every = splits[0]
    for s in splits[1:]:
        every = every.unionByName(s)
    return every.where(F.col(column).contains(part)).orderBy(F.xxhash64(F.lit(seed), column), column).limit(n)
