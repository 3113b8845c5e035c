"""Writing the events that pass the cuts back to Parquet.

Nothing that a save did not write itself is ever touched: an output that is, holds or lies in
an input fails before anything is written, an existing output fails unless ``replace`` is
set, and even then only one that carries the mark of a save is replaced, after the new one is complete.
A save that died while it replaced is finished by the next save to the place, or by ``finish_saves``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.operators.cuts import apply_cuts
from tallygrid.sources.events import file_stem, scan_events, source_file
from tallygrid.sources.commit import each, finish, marked, replace as put_in_place
from tallygrid.sources.paths import Folder, read_files, refuse_overlap
from tallygrid.specs import Cut

OUTPUT_COLUMN = "out_name"
DEFAULT_SUFFIX = "filtered"
_SHOWN = 20


def save_single(
    spark: SparkSession,
    paths: str | Sequence[str],
    cuts: Iterable[Cut],
    output: str,
    compact: bool = False,
    replace: bool = False,
    **cut_options,
) -> None:
    """All passing rows of all files as one Parquet table at ``output``.

    Every task writes its own rows. ``compact`` evens out file sizes first, by a
    rebalancing shuffle whose partitions are sized at run time. ``replace`` writes beside
    an existing output and takes its place once all is written.
    """
    target = Folder(spark, output)
    base, _, name = target.name.rpartition("/")
    finish(spark, base)
    events = scan_events(spark, paths)
    refuse_overlap(spark, [target.name], _as_list(paths), read_files(events))
    if target.exists():
        if not replace:
            raise ValueError(f"{output} exists already; replace=True replaces it")
        if not marked(target, spark):
            raise ValueError(f"{output} was not written by a save, so it is not replaced")
    rows = apply_cuts(events, cuts, **cut_options)
    if compact:
        rows = rows.hint("rebalance")
    staging = Folder(spark, f"{target.name}.new-{uuid.uuid4().hex}")
    try:
        rows.write.parquet(f"{staging.name}/rows")
    except Exception:
        staging.remove()
        raise
    put_in_place(spark, base, staging.name, {name: "rows"})


def save_separate(
    spark: SparkSession,
    paths: str | Sequence[str],
    cuts: Iterable[Cut],
    output: str,
    suffix: str = DEFAULT_SUFFIX,
    compact: bool = False,
    replace: bool = False,
    **cut_options,
) -> DataFrame:
    """One output per input file, under ``output/out_name={stem}_{suffix}``; returns the manifest.

    All files are read in one scan and written in one pass; the name of the output is a
    partition of the written table and no column of its files. Two inputs that would
    share an output fail before anything is written. ``compact`` merges small pieces
    and splits an output that holds most of the rows over several tasks.

    Only the outputs of this run are written, so other files in ``output``, other suffixes and
    the inputs themselves may lie there. ``replace`` puts new outputs in the place of old
    ones of the same name, and takes away that of an input none of whose rows pass now.
    """
    base = Folder(spark, output).name
    finish(spark, base)
    events = scan_events(spark, paths)
    if OUTPUT_COLUMN in events.columns:
        raise ValueError(f"the event table already has a column {OUTPUT_COLUMN!r}")
    files = read_files(events)
    named = _input_files(spark, files, suffix)
    clashes = named.groupBy(OUTPUT_COLUMN).count().where(F.col("count") > 1)
    shown = clashes.orderBy(OUTPUT_COLUMN).limit(_SHOWN).collect()
    if shown:
        names = [c[OUTPUT_COLUMN] for c in shown]
        raise ValueError(f"inputs share {clashes.count()} outputs, among them {names}")
    owned = {r[OUTPUT_COLUMN]: _partition(r[OUTPUT_COLUMN]) for r in named.collect()}
    refuse_overlap(spark, [f"{base}/{folder}" for folder in owned.values()], _as_list(paths), files)
    there = Folder(spark, base).names()
    present = [name for name, folder in owned.items() if folder in there]
    if present and not replace:
        shown = sorted(present)[:_SHOWN]
        raise ValueError(f"{len(present)} outputs exist already, among them {shown}; replace=True replaces them")
    own = each(lambda name: marked(Folder(spark, f"{base}/{owned[name]}"), spark), present)
    foreign = sorted(name for name, written in zip(present, own, strict=True) if not written)
    if foreign:
        raise ValueError(f"{len(foreign)} outputs were not written by a save, so they are not replaced, among them {foreign[:_SHOWN]}")

    tagged = events.select("*", _output_name(source_file(), suffix).alias(OUTPUT_COLUMN))
    rows = apply_cuts(tagged, cuts, **cut_options)
    if compact:
        rows = rows.hint("rebalance", OUTPUT_COLUMN)
    # Written beside and moved in: a failed job changes no output.
    staging = Folder(spark, f"{base}/_new-{uuid.uuid4().hex}")
    try:
        rows.write.partitionBy(OUTPUT_COLUMN).parquet(staging.name)
        schema = T.StructType([*events.schema.fields, T.StructField(OUTPUT_COLUMN, T.StringType())])
        kept = spark.read.schema(schema).parquet(staging.name).groupBy(OUTPUT_COLUMN).count().collect()
        counts = {row[OUTPUT_COLUMN]: row["count"] for row in kept}
    except Exception:
        staging.remove()
        raise
    moved = {owned[name]: owned[name] for name in counts}
    put_in_place(spark, base, staging.name, moved, {owned[name] for name in present} - set(moved))
    return _manifest(spark, named, counts)


def finish_saves(spark: SparkSession, folder: str) -> int:
    """Finish what saves into the folder left half replaced when they died; returns how many there were.

    Not for a folder into which another save is writing just now.
    """
    return finish(spark, Folder(spark, folder).name)


def save_cuts(
    spark: SparkSession,
    paths: str | Sequence[str],
    cuts: Iterable[Cut],
    output: str,
    mode: str = "separate",
    suffix: str = DEFAULT_SUFFIX,
    **options,
) -> DataFrame | None:
    """``save_separate`` (the default) or ``save_single``, by name."""
    if mode == "separate":
        return save_separate(spark, paths, cuts, output, suffix, **options)
    if mode == "single":
        save_single(spark, paths, cuts, output, **options)
        return None
    raise ValueError(f"mode must be 'separate' or 'single', not {mode!r}")


def _as_list(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))


def _partition(name: str) -> str:
    """The folder that Spark gives a partition: characters that paths can't hold are escaped."""
    escaped = "".join(f"%{ord(c):02X}" if c in _ESCAPED or ord(c) < 32 else c for c in name)
    return f"{OUTPUT_COLUMN}={escaped}"


# The characters that Spark escapes in the names of partition folders.
_ESCAPED = frozenset("\"#%'*/:=?\\\x7f{[]^")


def _output_name(file_name: Column, suffix: str) -> Column:
    return F.concat(file_stem(file_name), F.lit(f"_{suffix}"))


def _input_files(spark: SparkSession, files: Sequence[str], suffix: str) -> DataFrame:
    """``(source_file, out_name)`` of every file that the scan reads."""
    names = [(name.rsplit("/", 1)[-1],) for name in files]
    listed = spark.createDataFrame(names, "source_file string")
    return listed.select("source_file", _output_name(F.col("source_file"), suffix).alias(OUTPUT_COLUMN))


def _manifest(spark: SparkSession, named: DataFrame, counts: dict[str, int]) -> DataFrame:
    """``(source_file, out_name, rows)`` of this run, with 0 for an input none of whose rows passed."""
    written = spark.createDataFrame(list(counts.items()), f"{OUTPUT_COLUMN} string, kept long")
    return named.join(written, OUTPUT_COLUMN, "left").select(
        "source_file", OUTPUT_COLUMN, F.coalesce("kept", F.lit(0)).alias("rows")
    )
