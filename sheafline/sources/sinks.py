"""Artifacts to files: tasks stage them, and the commit moves them into place.

Spark's text sink can't choose names, so ``artifact_files`` is a sink of its own. A task
writes below a staging folder of its attempt; only files of successful tasks are moved, and
moving them again changes nothing.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import ship


def below(root: Path, path: str) -> Path:
    """Where the path is below the root; a path that leaves it is refused."""
    at = (root / path).resolve()
    if not at.is_relative_to(root) or at == root:
        raise ValueError(f"{path} isn't below {root}")
    return at


@dataclass
class Staged(WriterCommitMessage):
    """A task's files: (where they were staged, path below the root), in the order of the rows."""

    partition: int
    files: list[tuple[str, str]]


class ArtifactWriter(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.staging = Path(root).resolve(), Path(root).resolve() / f".staging-{job}"
        self.staging.mkdir(parents=True, exist_ok=True)

    def write(self, iterator: Iterator) -> Staged:
        context = TaskContext.get()
        partition, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        folder = self.staging / f"{partition}-{attempt}-{uuid.uuid4().hex}"
        folder.mkdir()  # fails once the job has been given up
        files = []
        for n, row in enumerate(iterator):
            below(self.root, row.path)
            at = folder / str(n)
            at.write_text(row.content or "", encoding="utf-8", newline="")
            files.append((str(at), row.path))
        return Staged(partition, files)

    def commit(self, messages: list[Staged | None]) -> None:
        """Move the files of successful tasks; of a path given several times, the last by partition and row stays."""
        done = []
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for staged, path in message.files:
                at = below(self.root, path)
                at.parent.mkdir(parents=True, exist_ok=True)
                if os.path.exists(staged):  # a commit that was broken off had moved the others
                    os.replace(staged, at)
                done.append(path)
        draft = self.staging / "paths"
        draft.write_text(json.dumps(done), encoding="utf-8")

    def abort(self, messages: list[Staged | None]) -> None:
        # renamed first: tasks that still run can't add to it any more
        gone = self.staging.with_name(self.staging.name + "-gone")
        if self.staging.exists():
            os.rename(self.staging, gone)
            shutil.rmtree(gone)


class ArtifactFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact_files"

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options["root"], self.options["job"])


def write_artifacts(artifacts: DataFrame, root: str) -> list[str]:
    """Write each (path, content) below the root, overwriting; the paths written, in order.

    The executors write, so the root must be where they all see it. A path that leaves the
    root fails the whole write, and then nothing is changed; nor is it by a failed task.
    """
    spark = artifacts.sparkSession
    ship(spark)
    spark.dataSource.register(ArtifactFiles)
    job = uuid.uuid4().hex
    try:
        artifacts.select("path", "content").write.format("artifact_files").option("root", root).option("job", job).mode("append").save()
    except PythonException as e:
        found = re.search(r"ValueError: (.* isn't below .*)", str(e))
        raise (ValueError(found[1]) if found else e) from None
    staging = Path(root).resolve() / f".staging-{job}"
    done = json.loads((staging / "paths").read_text(encoding="utf-8"))
    shutil.rmtree(staging)
    return done


def write_tables(artifacts: DataFrame, path: str) -> None:
    """The artifacts of many requests as Parquet, for those that don't want files."""
    artifacts.write.mode("overwrite").parquet(path)
