"""The rule corpus and the general guidelines.

Spark's path sources skip names that begin with a dot or an underscore, so second-tier
documents are listed on the driver; a corpus is small. A table of the same columns
(rule_name, tier, content) serves as well.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def normal_ends(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def read_text(path: Path) -> str | None:
    """The file as UTF-8 with line ends normalised; null if it can't be read or decoded."""
    try:
        return normal_ends(path.read_bytes().decode("utf-8"))
    except (OSError, UnicodeDecodeError):
        return None


def rule_corpus(spark: SparkSession, first: str, second: str | None = None, hidden: str = ".cursorrules") -> DataFrame:
    """Tier 1: ``first/<name>.mdc``. Tier 2: the entries of ``second`` with their hidden document, null if they have none."""
    rows = [(p.stem, 1, read_text(p)) for p in sorted(Path(first).glob("*.mdc"))]
    if second and Path(second).is_dir():
        rows += [(p.name, 2, read_text(p / hidden)) for p in sorted(Path(second).iterdir())]
    return spark.createDataFrame(rows, schema.CORPUS)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole visible text files, read by the executors."""
    got = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    ends = F.regexp_replace("value", "\r\n?", "\n")
    return got.select("path", ends.alias("content"))


def general_guidelines(path: str) -> str:
    """The guidelines' text; '' if there is no such file."""
    return read_text(Path(path)) or ""
