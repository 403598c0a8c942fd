"""Volumes, transforms, tags and option files on storage.

Volumes and grids are Parquet tables partitioned by volume. Transforms (.xfm) and tags (.tag) are small
text files; they are read and written with Spark's text source, so any file system works.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import GRIDS, TAGS, VOXELS

XFMS = T.StructType(
    [
        T.StructField("xfm_id", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("invert_flag", T.BooleanType()),
        T.StructField("matrix", T.ArrayType(T.DoubleType())),
        T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("displacements", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("grid_vol", T.StringType()),
    ]
)


def read_volume(spark: SparkSession, path: str, labels: bool = False) -> DataFrame:
    """Source, target and feature volumes as doubles, label volumes as integers."""
    df = spark.read.parquet(path)
    return df.withColumn("value", F.col("value").cast("int" if labels else "double"))


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """Voxels inside the mask; the others are not read further."""
    return spark.read.parquet(path).where("value > 0").select("vol", "i", "j", "k")


def write_volume(voxels: DataFrame, path: str, clobber: bool = False) -> None:
    voxels.write.mode("overwrite" if clobber else "errorifexists").partitionBy("vol").parquet(path)


def read_deformation(spark: SparkSession, base: str) -> DataFrame:
    """base_dx, base_dy, base_dz joined to one grid."""
    out = None
    for c in ("dx", "dy", "dz"):
        part = spark.read.parquet(f"{base}_{c}").withColumnRenamed("value", c)
        out = part if out is None else out.join(part, ["vol", "i", "j", "k"])
    return out.select(GRIDS.names)


def read_features(spark: SparkSession, base: str) -> DataFrame:
    """All blurred features of a base name, one column each: dx, dy, dz, dxyz, blur."""
    out = None
    for c in ("dx", "dy", "dz", "dxyz", "blur"):
        part = spark.read.parquet(f"{base}_{c}").withColumnRenamed("value", c)
        out = part if out is None else out.join(part, ["vol", "i", "j", "k"])
    return out


def write_deformation(grid: DataFrame, base: str, clobber: bool = False) -> None:
    for c in ("dx", "dy", "dz"):
        write_volume(component(grid, c), f"{base}_{c}", clobber)


def component(grid: DataFrame, name: str) -> DataFrame:
    """One component of a grid as a volume."""
    return grid.select("vol", "i", "j", "k", F.col(name).alias("value"))


def class_volumes(pairs: Iterable[tuple[DataFrame, int]]) -> DataFrame:
    """(volume, class) pairs as one table with a class column, in order."""
    out = None
    for order, (df, label) in enumerate(pairs):
        part = df.withColumn("label", F.lit(int(label))).withColumn("ord", F.lit(order))
        out = part if out is None else out.unionByName(part)
    return out


def feature_pairs(pairs: Iterable[dict]) -> list[dict]:
    """Feature pairs with the defaults filled in; objective names by their first two letters."""
    names = ("xcorr", "diff", "sqdiff", "label", "chamfer", "corrcoeff", "opticalflow")
    out = []
    for k, p in enumerate(pairs):
        asked = str(p.get("objective", "xcorr")).lower()
        found = next((n for n in names if n[:2] == asked[:2]), None)
        if found is None:
            raise ValueError(f"objective {asked}")
        out.append({"feature": k, "objective": found, "weight": float(p.get("weight", 1.0)), "thresh_data": float(p.get("thresh_data", 0.0)), "thresh_model": float(p.get("thresh_model", 0.0)), **{n: p.get(n) for n in ("data", "model", "data_mask", "model_mask")}})
    return out


OBJECTIVE_NAMES = ("xcorr", "diff", "sqdiff", "label", "chamfer", "corrcoeff", "opticalflow")


def objective_of(name: Column) -> Column:
    """The objective that a feature pair's option means: names count by their first two letters; null for any other, xcorr if none is given."""
    start = F.lower(F.substring(name, 1, 2))
    out = F.when(name.isNull(), "xcorr")
    for n in OBJECTIVE_NAMES:
        out = out.when(start == n[:2], n)
    return out


def feature_table(pairs: DataFrame) -> DataFrame:
    """The registry of feature pairs as a table: objectives resolved, weights 1 and thresholds 0 where not given."""
    given = lambda c, default: F.coalesce(F.col(c).cast("double"), F.lit(default)) if c in pairs.columns else F.lit(default)
    return pairs.withColumns({"objective": objective_of(F.col("objective")), "weight": given("weight", 1.0), "thresh_data": given("thresh_data", 0.0), "thresh_model": given("thresh_model", 0.0)})


def parse_xfm(text: str, name: str = "xfm") -> list[tuple]:
    """Rows of XFMS. The file is statements ended by `;`, comments from % on."""
    body = re.sub(r"%[^\n]*", "", text)
    if not re.match(r"\s*MNI Transform File", body):
        raise ValueError("not a transform file")
    rows, now = [], None
    for statement in body.split("\n", 1)[1].split(";") if "\n" in body else []:
        key, eq, value = statement.partition("=")
        key, value = key.strip(), value.strip()
        if not eq:
            if key:
                raise ValueError(f"no value: {key}")
            continue
        if key == "Transform_Type":
            now = {"type": value, "invert_flag": False}
            rows.append(now)
        elif now is None:
            raise ValueError(f"{key} before a type")
        elif key == "Invert_Flag":
            now["invert_flag"] = value.lower() == "true"
        elif key == "Linear_Transform":
            now["matrix"] = [float(x) for x in value.split()]
        elif key in ("Points", "Displacements"):
            n = np.array([float(x) for x in value.split()]).reshape(-1, 3).tolist()
            now[key.lower()] = n
        elif key == "Displacement_Volume":
            now["grid_vol"] = value
        elif key not in ("Number_Dimensions",):
            raise ValueError(key)
    return [(name, k, *(r.get(f) for f in XFMS.names[2:])) for k, r in enumerate(rows)]


def format_xfm(rows: Iterable[tuple], comment: str = "") -> str:
    """The text of transforms in order of seq."""
    out = ["MNI Transform File"] + [f"%{c}" for c in comment.split("\n") if c]
    for r in sorted(rows, key=lambda r: r[1]):
        _, _, kind, inverted, matrix, points, displacements, grid_vol = r
        out.append(f"\nTransform_Type = {kind};")
        if inverted:
            out.append("Invert_Flag = True;")
        if kind == "Linear":
            out.append("Linear_Transform =\n" + "\n".join(" " + " ".join(f"{x:.15g}" for x in matrix[4 * n : 4 * n + 4]) for n in range(3)) + ";")
        elif kind == "Thin_Plate_Spline_Transform":
            for title, table in (("Points", points), ("Displacements", displacements)):
                out.append(f"{title} =\n" + "\n".join(" " + " ".join(f"{x:.15g}" for x in p) for p in table) + ";")
        elif kind == "Grid_Transform":
            out.append(f"Displacement_Volume = {grid_vol};")
    return "\n".join(out) + "\n"


def read_xfm(spark: SparkSession, path: str) -> DataFrame:
    """One file: a few rows, parsed where it is read."""
    text = spark.read.text(path, wholetext=True).first()
    return spark.createDataFrame(parse_xfm(text[0], path), XFMS)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


TEXTS = "xfm_id string, text string"


def format_xfms(xfms: DataFrame) -> DataFrame:
    """(xfm_id, text) of each transform file: the steps of one id, in order of seq."""
    names = XFMS.names
    steps = F.array_sort(F.collect_list(F.struct("seq", *(c for c in names if c != "seq"))))
    lists = xfms.select(names).groupBy("xfm_id").agg(steps.alias("steps"))

    def run(parts):
        for t in parts:
            yield t.assign(text=[format_xfm([tuple(r[c] for c in names) for r in steps]) for steps in t["steps"]])[["xfm_id", "text"]]

    return lists.mapInPandas(run, TEXTS)


def parse_xfms(texts: DataFrame) -> DataFrame:
    """Rows of XFMS from (xfm_id, text)."""
    import pandas as pd

    def run(parts):
        for t in parts:
            yield pd.DataFrame([r for k, x in zip(t["xfm_id"], t["text"], strict=True) for r in parse_xfm(x, k)], columns=XFMS.names)

    return texts.select("xfm_id", "text").mapInPandas(run, XFMS)


def write_xfms(xfms: DataFrame, path: str) -> None:
    """A folder with one file for each transform, xfm_id=NAME below the path."""
    format_xfms(xfms).repartition("xfm_id").write.partitionBy("xfm_id").text(path)


def read_xfms(spark: SparkSession, path: str) -> DataFrame:
    """All transform files of such a folder."""
    texts = spark.read.schema("value string, xfm_id string").text(path, wholetext=True)
    return parse_xfms(texts.select("xfm_id", F.col("value").alias("text")))


def linear_matrix(xfm: DataFrame) -> np.ndarray:
    """The matrix of a file that holds one linear transform."""
    rows = xfm.limit(2).collect()
    if len(rows) != 1 or rows[0]["type"] != "Linear":
        raise ValueError("not one linear transform")
    m = np.eye(4)
    m[:3] = np.array(rows[0]["matrix"]).reshape(3, 4)
    return np.linalg.inv(m) if rows[0]["invert_flag"] else m


_TAG_LINE = r"^\s*((?:[-+0-9.eE]+\s+){2,5}[-+0-9.eE]+)"


def read_tags(spark: SparkSession, path: str, *keep: str) -> DataFrame:
    """Landmark pairs; files of one volume have null second points. keep: columns that the folder's names give."""
    body = F.regexp_extract("value", r"(?s)Points\s*=(.*?);", 1)
    lines = spark.read.text(path, wholetext=True).select(*keep, F.explode(F.split(body, "\n")).alias("line"))
    numbers = F.split(F.trim(F.regexp_extract("line", _TAG_LINE, 1)), r"\s+")
    found = lines.where(F.regexp_extract("line", _TAG_LINE, 1) != "").select(*keep, numbers.alias("n"), F.regexp_extract("line", r'"([^"]*)"', 1).alias("label"))
    return found.select(*keep, *(F.try_element_at("n", F.lit(k + 1)).cast("double").alias(c) for k, c in enumerate(TAGS.names[:6])), "label")


def format_tags(rows: Iterable[tuple]) -> str:
    rows = list(rows)
    two = any(r[3] is not None for r in rows)
    body = "\n".join(" " + " ".join(f"{x:.15g}" for x in r[: 6 if two else 3]) + f' "{r[6] or ""}"' for r in rows)
    return f"MNI Tag Point File\nVolumes = {2 if two else 1};\n\nPoints =\n{body};\n"


def tag_files(tags: DataFrame, by: str) -> DataFrame:
    """(by, text) of a tag file for each group of landmark pairs, points in the order of their columns."""
    two = F.max(F.col("x2").isNotNull())
    line = lambda n: F.concat(F.lit(" "), F.concat_ws(" ", *(F.col(f"{a}{k}").cast("string") for k in range(1, n + 1) for a in "xyz")), F.lit(' "'), F.coalesce("label", F.lit("")), F.lit('"'))
    lines = lambda n: F.array_join(F.array_sort(F.collect_list(line(n))), "\n")
    body = F.when(two, lines(2)).otherwise(lines(1))
    head = F.concat(F.lit("MNI Tag Point File\nVolumes = "), F.when(two, "2").otherwise("1"), F.lit(";\n\nPoints =\n"))
    return tags.groupBy(by).agg(F.concat(head, body, F.lit(";\n")).alias("text"))


def write_tag_files(tags: DataFrame, by: str, path: str) -> None:
    tag_files(tags, by).repartition(by).write.partitionBy(by).text(path)


def option_table(texts: DataFrame, order: str = "ord", text: str = "text") -> DataFrame:
    """(name, value) of all options of files in an order; later lines and later files win."""
    lines = texts.select(order, F.posexplode(F.split(F.col(text), "\n")).alias("_n", "_line"))
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace("_line", "#.*", ""), "=", " ")), r"\s+")
    named = lines.withColumn("_w", words).where(F.element_at("_w", 1) != "")
    value = F.array_join(F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), " ")
    return named.groupBy(F.regexp_replace(F.element_at("_w", 1), "^-+", "").alias("name")).agg(F.max_by(value, F.struct(order, "_n")).alias("value"))


_NUMBER = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of points, six numbers on a line; other lines are skipped."""
    lines = spark.read.text(path).select(F.regexp_extract_all("value", F.lit(f"({_NUMBER})"), 1).alias("n")).where(F.size("n") >= 6)
    return lines.select(*(F.element_at("n", k + 1).cast("double").alias(f"{a}{b}") for k, (b, a) in enumerate((b, a) for b in (1, 2) for a in "xyz")))


def read_grid_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Scattered nodes and their displacements from text: x y z dx dy dz on a line."""
    return read_points(spark, path).toDF("x", "y", "z", "dx", "dy", "dz")


def without_zeros(voxels: DataFrame, columns=("value",), least: float = 1e-6) -> DataFrame:
    """Exact zeros, which would divide, become a very small value."""
    return voxels.withColumns({c: F.when(F.col(c) == 0, least).otherwise(F.col(c)) for c in columns})


def with_history(voxels: DataFrame, argv: list[str], when: str = "", column: str = "value") -> DataFrame:
    """The command line behind the history that the table's column carries; Parquet keeps it."""
    had = history_of(voxels, column)
    return voxels.withMetadata(column, {"history": "\n".join(x for x in (had, history(argv, when)) if x)})


def history_of(voxels: DataFrame, column: str = "value") -> str:
    return voxels.schema[column].metadata.get("history", "")


def write_snapshot(df: DataFrame, base: str, iteration: int) -> None:
    """The state after an iteration, below base/iteration=N."""
    df.write.mode("overwrite").parquet(f"{base}/iteration={iteration}")


def read_snapshots(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(base)


def evaluation_log(evaluations: DataFrame, order: list[str], value: str) -> DataFrame:
    """Numbers evaluations of an objective in their order, with the best value so far."""
    w = Window.orderBy(*order)
    return evaluations.withColumns({"evaluation": F.row_number().over(w), "best": F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def same_shape(volumes: DataFrame, by: str = "vol") -> DataFrame:
    """Whether each volume has as many voxels along every axis as the first one by name."""
    shape = volumes.groupBy(by).agg(*((F.max(a) + 1).alias(f"n{a}") for a in ("i", "j", "k")))
    first = shape.agg(*(F.min_by(f"n{a}", by).alias(f"f{a}") for a in ("i", "j", "k")))  # one row
    ok = (F.col("ni") == F.col("fi")) & (F.col("nj") == F.col("fj")) & (F.col("nk") == F.col("fk"))
    return shape.crossJoin(F.broadcast(first)).select(by, "ni", "nj", "nk", ok.alias("ok"))


def read_options(texts: Iterable[str]) -> dict[str, list[str]]:
    """Option files: `name value ...` lines, # comments; later files win."""
    out: dict[str, list[str]] = {}
    for text in texts:
        for line in text.split("\n"):
            words = re.sub(r"#.*", "", line).replace("=", " ").split()
            if words:
                out[words[0].lstrip("-")] = words[1:]
    return out


def history(argv: list[str], when: str = "") -> str:
    """The command line as a note for a table's properties."""
    return f"{when}>>> {' '.join(argv)}".strip()


EMPTY = {"voxels": VOXELS, "grids": GRIDS, "tags": TAGS, "xfms": XFMS}
