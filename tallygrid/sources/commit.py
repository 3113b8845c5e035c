"""Putting complete new outputs in the place of old ones, so that a death in between can be made good.

A save writes all of its rows into a folder beside the outputs. Then it leaves a record of what is to move
where, and only then touches an old output. The record goes last. ``finish`` does what a record still asks
for; every step can be done again, so it does not matter where the save died, or how often. Before the record
there is nothing to finish: old outputs are whole and the folder beside them is left over.

What is moved in carries a mark; without it nothing is ever replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from tallygrid.sources.paths import Folder

MARK = "_saved_by_tallygrid"
RECORD = "_replace-"
#: Renames that are under way at once.
AT_ONCE = 16


def marked(folder: Folder, spark: SparkSession) -> bool:
    """Whether a save of this package wrote the folder."""
    return Folder(spark, f"{folder.name}/{MARK}").exists()


def each(work, items: Iterable) -> list:
    """The results of file system calls, several at once; the first failure is raised."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(work, items))


def replace(spark: SparkSession, base: str, staging: str, moved: dict[str, str], dropped: Iterable[str] = ()) -> None:
    """Move folders of ``staging`` to names in ``base``, in the place of what is there; drop other names.

    ``moved`` maps names below ``base`` to names below ``staging``. All outputs must be written by then.
    """
    each(lambda name: Folder(spark, f"{staging}/{name}/{MARK}").write_text("1"), moved.values())
    record = Folder(spark, f"{base}/{RECORD}{uuid.uuid4().hex}.json")
    record.write_text(json.dumps({"staging": staging, "moved": moved, "dropped": sorted(dropped)}))
    _carry_out(spark, base, record)


def finish(spark: SparkSession, base: str) -> int:
    """Finish the replacements in ``base`` that were left half done; returns how many there were."""
    records = sorted(n for n in Folder(spark, base).names() if n.startswith(RECORD) and n.endswith(".json"))
    for name in records:
        _carry_out(spark, base, Folder(spark, f"{base}/{name}"))
    return len(records)


def _carry_out(spark: SparkSession, base: str, record: Folder) -> None:
    asked = json.loads(record.read_text())
    staging, moved = asked["staging"], asked["moved"]
    waiting, there = Folder(spark, staging).names(), Folder(spark, base).names()
    old = f"{staging}/_old"
    Folder(spark, old).make()

    def put(name: str) -> None:
        # Gone from the folder beside: it has been moved in before.
        if moved[name] in waiting:
            if name in there:
                Folder(spark, f"{base}/{name}").move_to(f"{old}/{name}")
            Folder(spark, f"{staging}/{moved[name]}").move_to(f"{base}/{name}")

    def drop(name: str) -> None:
        if name in there:
            Folder(spark, f"{base}/{name}").move_to(f"{old}/{name}")

    each(put, moved)
    each(drop, asked["dropped"])
    Folder(spark, staging).remove()
    record.remove()
