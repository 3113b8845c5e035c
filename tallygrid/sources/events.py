"""Finding and scanning Parquet event files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.sources.paths import Folder


def display_name(file_name: Column) -> Column:
    """File name without a trailing ``.parquet``."""
    return F.regexp_replace(file_name, r"\.parquet$", "")


def file_stem(file_name: Column) -> Column:
    """File name without its last extension; a name that only is an extension stays whole."""
    return F.regexp_replace(file_name, r"^(.+)\.[^.]*$", "$1")


def source_file() -> Column:
    """Name of the file a row was read from. Spark gives it in URI form, where + is a plain sign."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def _last_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_catalogue(spark: SparkSession, directory: str | Sequence[str]) -> DataFrame:
    """``(path, name, length, modified)`` of the Parquet files right in a directory, newest first.

    Only the listing is read, never the content. Files in sub-directories do not count;
    the extension must be exactly ``parquet``.
    """
    where = [directory] if isinstance(directory, str) else list(directory)
    globs = [f"{one.rstrip('/')}/*.parquet" for one in where]
    filled = [glob for glob in globs if Folder(spark, glob).matches()]
    if not filled:
        return spark.createDataFrame([], "path string, name string, length long, modified timestamp")
    listed = spark.read.format("binaryFile").load(filled)
    # A folder that is called *.parquet is a table, its part files lie deeper.
    folders = [name for one in where for name in Folder(spark, one).matches()]
    parent = F.regexp_replace("path", r"/[^/]*$", "")
    return listed.where(parent.isin(folders)).select(
        "path",
        display_name(_last_part(F.col("path"))).alias("name"),
        "length",
        F.coalesce("modificationTime", F.timestamp_seconds(F.lit(0))).alias("modified"),
    ).orderBy(F.col("modified").desc(), "path")


def select_files(
    catalogue: DataFrame, include: Iterable[str] | None = None, exclude: Iterable[str] = ()
) -> DataFrame:
    """The chosen files, each path once: all of them, or those named, less the excluded.

    Names are display names or full paths.
    """

    def named(names: Iterable[str]) -> Column:
        wanted = list(names)
        return F.col("name").isin(wanted) | F.col("path").isin(wanted)

    chosen = catalogue if include is None else catalogue.where(named(include))
    excluded = list(exclude)
    if excluded:
        chosen = chosen.where(~named(excluded))
    return chosen.dropDuplicates(["path"])


def toggle_file(selection: Sequence[str], path: str) -> list[str]:
    """The selection without the path if it is in there, else with it at the end."""
    if path in selection:
        return [p for p in selection if p != path]
    return [*selection, path]


def scan_events(
    spark: SparkSession, paths: str | Iterable[str], source_column: str | None = None
) -> DataFrame:
    """All files as one table, row-wise; files, directories and globs may be mixed.

    ``source_column`` adds the name of the file each row came from, so that per-file
    work needs no loop over files. A repeated path is read once.
    """
    chosen = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    if not chosen:
        raise ValueError("no event files chosen")
    events = spark.read.parquet(*chosen)
    if source_column is None:
        return events
    if source_column in events.columns:
        raise ValueError(f"the event table already has a column {source_column!r}")
    return events.select("*", source_file().alias(source_column))


def scan_selected(selection: DataFrame, source_column: str | None = None) -> DataFrame:
    """The files of a selection (a catalogue or part of one) as one table.

    Only the paths come to the driver, which hands them to the reader anyway.
    """
    paths = [row["path"] for row in selection.select("path").collect()]
    return scan_events(selection.sparkSession, paths, source_column)
