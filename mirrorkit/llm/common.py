"""Small helpers shared by the operators: tables, words, keys and column names."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, wherever they were started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="run-")) / f"{package.name}-code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))  # the driver serves the file for as long as the application runs
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows that one Arrow batch hands to a Python task; whole texts can be long."""
    ship(spark)
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < now <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, made longer until no column of ``df`` has it (names do not differ by case alone)."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_key(*cols: Column) -> Column:
    """128 bits of what the columns hold; equal values have equal keys, null included."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(7), *cols, F.lit(11)).alias("b"))


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
