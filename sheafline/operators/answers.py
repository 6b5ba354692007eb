"""Answers of an outside model, each asked for once: a table from the prompt's digest to its answer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

SCHEMA = "digest string, answer string"


class Spool:
    """Answers as single files, until the table has them: a task that is run again finds those that it had got."""

    def __init__(self, at: str):
        self.fs, self.path = pafs.FileSystem.from_uri(at)

    def get(self, digest: str) -> str | None:
        at = f"{self.path}/{digest}.json"
        if self.fs.get_file_info(at).type != pafs.FileType.File:
            return None
        with self.fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def put(self, digest: str, answer: str) -> None:
        """Written under another name and then moved, so that no half answer is ever found."""
        self.fs.create_dir(self.path, recursive=True)
        draft = f"{self.path}/{digest}.{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(answer).encode())
        self.fs.move(draft, f"{self.path}/{digest}.json")

    def clear(self) -> None:
        if self.fs.get_file_info(self.path).type == pafs.FileType.Directory:
            self.fs.delete_dir(self.path)


def table(spark: SparkSession, at: str) -> DataFrame:
    """(digest, answer) of what has been answered; of a digest that two runs answered at once, the smaller answer."""
    try:
        got = spark.read.schema(SCHEMA).parquet(f"{at}/answers")
    except AnalysisException:  # nothing yet
        return spark.createDataFrame([], SCHEMA)
    return got.groupBy("digest").agg(F.min("answer").alias("answer"))


def answer_once(prompts: DataFrame, ask: Callable[[str], str | None] | None, at: str, key: str = "request_id", model: str = "") -> DataFrame:
    """(key, answer) for ``prompts(key, prompt)``, asking only what the table in the folder ``at`` doesn't answer.

    Equal prompts to one ``model`` are asked once. Each answer is kept as soon as it is there, so neither a
    task that is run again nor a later run asks for it. A prompt without an answer (None)
    stays unanswered and is asked again by a later run; null prompts are never asked. The
    folder must be one that all executors share. Without a completion only known answers
    are given.
    """
    spark = prompts.sparkSession
    marked = prompts.select(key, "prompt", F.sha2(F.concat(F.lit(model + "\n"), "prompt"), 256).alias("digest"))
    if ask is not None:
        ship(spark)
        spool = f"{at}/spool"

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = Spool(spool)
            for frame in frames:
                out = []
                for digest, prompt in zip(frame["digest"], frame["prompt"]):
                    answer = kept.get(digest)
                    if answer is None and (answer := ask(prompt)) is not None:
                        kept.put(digest, answer)
                    out.append(answer)
                yield pd.DataFrame({"digest": frame["digest"], "answer": out})

        wanted = marked.where("prompt IS NOT NULL").groupBy("digest").agg(F.min("prompt").alias("prompt"))
        missing = wanted.join(table(spark, at), "digest", "left_anti")
        missing.mapInPandas(run, SCHEMA).where("answer IS NOT NULL").write.mode("append").parquet(f"{at}/answers")
        Spool(spool).clear()
    return marked.join(table(spark, at), "digest", "left").select(key, "answer")
