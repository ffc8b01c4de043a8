"""Files that are placed by Spark jobs, all of them or none: a data source that is written to.

Tasks copy each file (or write its rating into a copy) to a staging folder on the target's own file system and keep
a list of what they staged. Only when all tasks are done are the lists of those attempts that count taken up, and
each file takes its place in one step; what is left of other attempts goes. If the job fails, or is stopped, staging
folders go, and the destination is as it was. A repeat places the same files.
"""

from __future__ import annotations

import json
import os
import shutil
import urllib.parse
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from framesift.storage import shared_dir

OUTCOME = "id string, status string, error string"


@dataclass
class Staged(WriterCommitMessage):
    """The list of what one attempt of a task staged."""

    lines: str


def copied(row: Row, staged: str) -> None:
    """A copy of the file at ``path``."""
    shutil.copy2(row["path"], staged)


class PlacedFiles(DataSource):
    """Takes rows of id, path and, unless each file is its own target, target below ``destination``.

    Options: ``job``, a name of its own; ``lists``, a folder that driver and tasks share; ``destination``, if files have
    targets; ``move``, whether they leave their place; ``make``, module:function that writes a row's file to a path.
    """

    @classmethod
    def name(cls) -> str:
        return "placed_files"

    def writer(self, schema: StructType, overwrite: bool) -> Placer:
        return Placer(self.options["job"], self.options["lists"], self.options.get("destination"), self.options.get("move") == "true", self.options["make"])


class Placer(DataSourceWriter):
    """Stages files in tasks, and places them once all tasks are done."""

    def __init__(self, job: str, lists: str, destination: str | None, move: bool, make: str):
        self.job, self.lists, self.destination, self.move, self.make = job, lists, destination, move, make

    def _staging(self, target: str) -> str:
        """The staging folder on a target's own file system; it is known before anything is in it, so that it can always be removed."""
        folder = os.path.join(self.destination or os.path.dirname(target), f".staged-{self.job}")
        if not os.path.isdir(folder):
            known = os.path.join(self.lists, "folders")
            os.makedirs(known, exist_ok=True)
            with open(os.path.join(known, urllib.parse.quote(folder, safe="")[-200:] + uuid.uuid4().hex), "w") as f:
                f.write(folder)
            os.makedirs(folder, exist_ok=True)
        return folder

    def _stage(self, row: Row, make: Callable[[Row, str], None]) -> dict:
        out = {"id": row["id"], "status": "processed", "error": None}
        try:
            target = os.path.join(self.destination, row["target"]) if self.destination else row["path"]
            if not os.path.exists(row["path"]):
                return out | {"status": "processed" if self.move and os.path.exists(target) else "skipped"}  # moved by an earlier run
            staged = os.path.join(self._staging(target), uuid.uuid4().hex)
            make(row, staged)
            return out | {"staged": staged, "target": target, "source": row["path"]}
        except (OSError, ValueError, TypeError) as e:
            return out | {"status": "failed", "error": str(e)}

    def write(self, iterator: Iterator[Row]) -> Staged:
        import importlib

        module, _, function = self.make.partition(":")
        make, task = getattr(importlib.import_module(module), function), TaskContext.get()
        lines = os.path.join(self.lists, f"staged-{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}")
        os.makedirs(self.lists, exist_ok=True)
        with open(lines, "w") as f:
            for row in iterator:
                f.write(json.dumps(self._stage(row, make)) + "\n")
        return Staged(lines)

    def commit(self, messages: list[Staged | None]) -> None:
        """Place what was staged, a line at a time, then drop what is left."""
        os.makedirs(os.path.join(self.lists, "outcomes"), exist_ok=True)
        for message in messages:
            if message is None:
                continue
            outcomes = os.path.join(self.lists, "outcomes", os.path.basename(message.lines) + ".json")
            with open(message.lines) as lines, open(outcomes + ".part", "w") as out:
                for line in map(json.loads, lines):
                    if "staged" in line:
                        try:
                            self._place(line)
                        except OSError as e:
                            line |= {"status": "failed", "error": str(e)}
                    out.write(json.dumps({k: line[k] for k in ("id", "status", "error")}) + "\n")
            os.replace(outcomes + ".part", outcomes)
        self._clear()

    def _place(self, line: dict) -> None:
        os.makedirs(os.path.dirname(line["target"]), exist_ok=True)
        os.replace(line["staged"], line["target"])
        if self.move and os.path.exists(line["source"]):
            os.remove(line["source"])

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        known = os.path.join(self.lists, "folders")
        for name in os.listdir(known) if os.path.isdir(known) else ():
            with open(os.path.join(known, name)) as f:
                shutil.rmtree(f.read(), ignore_errors=True)


def placed(files: DataFrame, make: Callable[[Row, str], None], destination: str | None = None, move: bool = False) -> DataFrame:
    """Place files and return id, status and error of each: processed, skipped (no such file) or failed.

    For files on a file system that all executors mount, as is the shared folder, which takes the lists. A file that
    can't be read or made is a failed row; a job that fails raises, and has changed nothing.
    """
    spark = files.sparkSession
    spark.dataSource.register(PlacedFiles)
    folder = shared_dir(spark)
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError("files are placed on mounted file systems, and so is the shared folder")
    job = uuid.uuid4().hex
    lists = os.path.join("/" + folder.removeprefix("file:").lstrip("/"), f"placed-{job}")
    writer = files.write.format("placed_files").mode("append").option("job", job).option("lists", lists).option("make", f"{make.__module__}:{make.__name__}").option("move", str(move).lower())
    (writer.option("destination", destination) if destination else writer).save()
    os.makedirs(os.path.join(lists, "outcomes"), exist_ok=True)
    return spark.read.schema(OUTCOME).json(f"file://{lists}/outcomes")
