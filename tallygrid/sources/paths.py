"""Paths as the file system of the session sees them."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """A path with its file system: qualified name, existence, and the few changes that saving needs."""

    def __init__(self, spark: SparkSession, path: str):
        files = spark._jvm.org.apache.hadoop.fs
        self._make = files.Path
        plain = self._make(path)
        self._files = plain.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._path = self._files.makeQualified(plain)
        self.name = self._path.toString().rstrip("/")

    def exists(self) -> bool:
        return self._files.exists(self._path)

    def remove(self) -> None:
        self._files.delete(self._path, True)

    def move_to(self, name: str) -> None:
        if not self._files.rename(self._path, self._make(name)):
            raise OSError(f"{self.name} could not be moved to {name}")

    def names(self) -> set[str]:
        """The last parts of the names right in the folder, from one listing; empty if there is no folder."""
        if not self._files.exists(self._path):
            return set()
        return {status.getPath().getName() for status in self._files.listStatus(self._path)}

    def write_text(self, text: str) -> None:
        """A small file, in place only once it is complete."""
        aside = self._make(f"{self.name}.part")
        stream = self._files.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._files.rename(aside, self._path):
            raise OSError(f"{self.name} could not be written")

    def read_text(self) -> str:
        stream = self._files.open(self._path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def make(self) -> None:
        self._files.mkdirs(self._path)

    def matches(self) -> list[str]:
        """The qualified names that the path, which may be a glob, stands for now."""
        return [status.getPath().toString().rstrip("/") for status in self._files.globStatus(self._path) or ()]


def read_files(events: DataFrame) -> list[str]:
    """Qualified names of the files that a scan reads."""
    return [unquote(name).replace(":///", ":/", 1) for name in events.inputFiles()]


def first_overlap(outputs: Iterable[str], inputs: Iterable[str]) -> tuple[str, str] | None:
    """An output and an input of which one is the other or lies inside it; None if there is no such pair.

    Names are compared with their own upper folders, and with the first of the sorted inputs that could lie below
    them, so the work grows with the number of names and not with that of pairs.
    """
    named = sorted(set(inputs))
    known = set(named)
    for output in outputs:
        parts = output.split("/")
        for size in range(len(parts), 0, -1):
            if "/".join(parts[:size]) in known:
                return output, "/".join(parts[:size])
        at = bisect_left(named, f"{output}/")
        if at < len(named) and named[at].startswith(f"{output}/"):
            return output, named[at]
    return None


def refuse_overlap(spark: SparkSession, outputs: Iterable[str], paths: Iterable[str], files: Iterable[str]) -> None:
    """Raise if an output is, holds or lies in a file that is read or a folder that was named."""
    named = [match for path in paths for match in Folder(spark, path).matches()]
    struck = first_overlap(outputs, [*named, *files])
    if struck is not None:
        raise ValueError(f"output {struck[0]} and input {struck[1]} overlap")
