"""Loaders with declared columns, file round trips and the dataset card."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text tables: id column, text column.
TEXTS = {"documents": ("doc_id", "text"), "pages": ("page_id", "html"), "conversations": ("conv_id", "text"), "benchmark": ("item_id", "text")}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


#: Lists of the paths made within each open `storing`.
_open: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, whatever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def storing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function that stores a result. On leaving, all other tables made within go, which results are read from.

    with storing(spark) as store:
        result = store(similarity.near_copies(docs), "classes")
    """
    made: list[str] = []
    kept: set[str] = set()

    def store(df: DataFrame, name: str) -> DataFrame:
        path = shared_folder(spark, name)
        df.write.parquet(path)
        kept.add(path)
        return spark.read.schema(df.schema).parquet(path)

    _open.append(made)
    try:
        yield store
    finally:
        _open.remove(made)
        for path in made:
            if path not in kept:
                remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BAD = "_bad_record"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines by a declared schema; a line that does not fit it is null but for BAD, which holds the line."""
    return spark.read.schema(f"{schema}, {BAD} string").option("columnNameOfCorruptRecord", BAD).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header by a declared schema; a row that does not fit it keeps what does, and is whole in BAD."""
    how = {"quote": '"', "escape": '"', "multiLine": "true", "header": "true", "columnNameOfCorruptRecord": BAD, "mode": "PERMISSIVE"}
    return spark.read.schema(f"{schema}, {BAD} string").options(**how).csv(path)


def through_json(df: DataFrame) -> DataFrame:
    """df written as JSON Lines and read back with its own schema."""
    path = shared_folder(df.sparkSession, "json")
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def through_csv(df: DataFrame) -> DataFrame:
    """df written as CSV, all strings quoted, and read back with its own schema."""
    path = shared_folder(df.sparkSession, "csv")
    how = {"quote": '"', "escape": '"', "multiLine": "true", "header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.options(quoteAll="true", **how).csv(path)
    return df.sparkSession.read.schema(df.schema).options(**how).csv(path)


def card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a text table: rows, nulls, id range, characters."""
    cards = [
        load(spark, sf_dir, name).agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("n_rows"),
            F.count_if(F.col(text).isNull()).alias("n_null_text"),
            F.min(key).alias("min_id"),
            F.max(key).alias("max_id"),
            F.countDistinct(key).alias("n_ids"),
            F.sum(F.length(text)).alias("n_chars"),
        )
        for name, (key, text) in TEXTS.items()
    ]
    out = cards[0]
    for c in cards[1:]:
        out = out.unionByName(c)
    return out
