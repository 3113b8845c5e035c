"""Cuts as JSON, one object per file."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.sources.paths import Folder
from tallygrid.specs import Cut, unique_cuts

CUT_SCHEMA = T.StructType(
    [
        T.StructField("vertices", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("selected_vertex_index", T.LongType()),
        T.StructField("selected_x_column", T.StringType()),
        T.StructField("selected_y_column", T.StringType()),
    ]
)

_TABLE_SCHEMA = T.StructType([T.StructField("cut_id", T.StringType()), *CUT_SCHEMA.fields])


def cut_table(spark: SparkSession, cuts: Iterable[Cut]) -> DataFrame:
    """One row per cut: its id and the fields of its file."""
    rows = [
        (cut.cut_id, [list(v) for v in cut.vertices], None, cut.x_column, cut.y_column)
        for cut in unique_cuts(cuts)
    ]
    return spark.createDataFrame(rows, _TABLE_SCHEMA)


def save_cut(
    spark: SparkSession, cut: Cut, directory: str, name: str | None = None, replace: bool = False
) -> str:
    """Write one cut as JSON under ``directory`` and return where it went.

    The default name is made of the two columns. Like every Spark output it is a folder
    with one file in it, which ``load_cuts`` and any JSON reader of that file understand.
    What lies there already is replaced only if asked for, and only if it is a cut.
    """
    if not cut.usable:
        raise ValueError(f"cut {cut.cut_id!r} needs both columns before it can be saved")
    target = f"{directory.rstrip('/')}/{name or cut.default_file_name}"
    if Folder(spark, target).exists():
        if not replace:
            raise ValueError(f"{target} exists already; replace=True replaces it")
        load_cuts(spark, [target])
    one = cut_table(spark, [cut]).drop("cut_id").coalesce(1)
    one.write.mode("overwrite").option("ignoreNullFields", "false").json(target)
    return target


def load_cuts(spark: SparkSession, paths: Sequence[str]) -> list[Cut]:
    """The cuts of the given files, as ``cut_1``, ``cut_2``, ... in the order of the paths.

    A cut is part of the query, not data: a few kilobytes that end up in the plan.
    """
    if not paths:
        return []
    read = spark.read.schema(CUT_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST")
    named = [Folder(spark, path).name for path in paths]
    rows = read.json(list(dict.fromkeys(paths))).select(*CUT_SCHEMA.names, F.col("_metadata.file_path").alias("file"))
    found = [(unquote(row["file"]).replace(":///", ":/", 1), row) for row in rows.limit(2 * len(paths) + 1).collect()]
    cuts = []
    for number, (path, name) in enumerate(zip(paths, named), start=1):
        own = [row for file, row in found if file == name or file.startswith(f"{name}/")]
        if len(own) != 1:
            raise ValueError(f"{path} must hold exactly one cut")
        cuts.append(_cut_of(f"cut_{number}", path, own[0]))
    return cuts


def _cut_of(cut_id: str, path: str, row: T.Row) -> Cut:
    vertices = row["vertices"]
    if vertices is None or any(v is None or len(v) != 2 or None in v for v in vertices):
        raise ValueError(f"{path} has no list of two-number vertices")
    corners = tuple((v[0], v[1]) for v in vertices)
    return Cut(cut_id, corners, row["selected_x_column"], row["selected_y_column"])


