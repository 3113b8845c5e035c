"""What the operators share: tables, folds, samples and written intermediate results."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.plans.workloads import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(frame: DataFrame) -> DataFrame:
    """The same frame, after this package was handed to Spark for its Python workers, once a session."""
    context = frame.sparkSession.sparkContext
    if getattr(context, "_tallygrid_shipped", False):
        return frame
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="tallygrid-code-"), "tallygrid_code.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted((root / "tallygrid").rglob("*.py")):
            packed.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    context._tallygrid_shipped = True
    return frame


def text_of(name: str = "text") -> Column:
    """The text of a row; a null is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(id_name: str, folds: int, held: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``held``; false for a null id."""
    rest = F.crc32(F.col(id_name).cast("string").cast("binary")) % F.lit(folds)
    return F.coalesce(rest == held, F.lit(False))


def stored(frame: DataFrame, name: str, **options) -> DataFrame:
    """The rows, written to the shared scratch folder and read back, so lineage ends here; ``options`` are the writer's."""
    path = f"{scratch_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    frame.write.options(**options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def unused_names(frame: DataFrame, *wanted: str) -> list[str]:
    """Names for added columns that no column of the frame has."""
    taken = {name.lower() for name in frame.columns}
    found = []
    for name in wanted:
        while name in taken:
            name += "_"
        found.append(name)
    return found


def hashed_share(id_name: str, share: dict, by: str) -> Column:
    """Rows of a sample by hash of the id: of each value of ``by`` about the given share.

    The same rows come whenever it runs, and no group has to meet in one task for it.
    """
    place = F.pmod(F.xxhash64(F.col(id_name)), F.lit(1 << 30))
    chosen = F.lit(False)
    for value, part in share.items():
        chosen = chosen | ((F.col(by) == F.lit(value)) & (place < F.lit(int(part * (1 << 30)) + 1)))
    return chosen
