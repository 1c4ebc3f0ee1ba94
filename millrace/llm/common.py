"""What the operators share: the scratch folder, table reading and expression helpers."""

from __future__ import annotations

import ctypes
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts that take words between ASCII white space.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share.

    Only where the session names no such folder (tests on one machine) is a local one set.
    """
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


_open: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder, on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def storing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], tuple[DataFrame, str]]]:
    """Gives a function that stores a result, as (table, path). On leaving, other scratch folders made within go."""
    made: list[str] = []
    stored: set[str] = set()

    def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch(spark, name)
        df.write.parquet(path)
        stored.add(path)
        return spark.read.schema(df.schema).parquet(path), path

    _open.append(made)
    try:
        yield store
    finally:
        _open.remove(made)
        for path in made:
            if path not in stored:
                remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the scratch folder: cuts lineage, and outlives the executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back(heap: bool = True) -> None:
    """Returns freed memory to the system: Spark keeps idle Python workers, and these what they once needed.

    Arrow's pool goes for next to nothing; the heap costs tenths of a second where it was large.
    """
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if heap else None  # glibc has it
    if trim:
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores before it until no column of df has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> Column:
    """A column by its name, whatever the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain(docs: DataFrame, **roles: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs under plain names, and a function that gives a result of it docs' names back.

    roles: a name for each column that is worked on, as in text="body"; all others get numbers, so no name of theirs
    can clash with an operator's own, hold a dot or differ in case alone. The function takes a result that has
    docs' columns, or some of them, and the names of those that were added; columns of docs with such a name (in any
    case) give way.
    """
    at = {c: r for r, c in roles.items()}
    names = [at.get(c, f"col_{i}") for i, c in enumerate(docs.columns)]

    def back(df: DataFrame, *added: str) -> DataFrame:
        gone = {a.lower() for a in added}
        own = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if n in df.columns and c.lower() not in gone]
        return df.select(*own, *added)

    return docs.toDF(*names), back


def constant(values: list, kind: str) -> Column:
    """A constant array<kind>, folded to one literal."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


#: Words of a row bitmap that are broadcast: each stands for 64 rows and takes some 50 bytes.
MAX_BITMAP_WORDS = 1_000_000


def with_rows_of(rows: DataFrame, row: str, chosen: DataFrame, wanted: bool = True, max_words: int = MAX_BITMAP_WORDS) -> DataFrame:
    """The rows whose number is in chosen (one long column, no nulls), or with wanted=False the others.

    The numbers meet the rows as a bitmap by 64 rows, a hundredth of a text's size, which is broadcast up to
    max_words; the rows themselves are shuffled only beyond that.
    """
    word, bits = fresh(rows, "bitmap_word", "bitmap")
    number = F.col(chosen.columns[0])
    mask = F.expr(f"shiftleft(1L, cast({chosen.columns[0]} & 63 AS INT))")
    bitmap = written(chosen.groupBy(F.shiftright(number, 6).alias(word)).agg(F.bit_or(mask).alias(bits)), "bitmap")
    if bitmap.count() > max_words:
        return rows.join(chosen.select(number.alias(row)), row, "left_semi" if wanted else "left_anti").select(rows.columns)
    joined = rows.withColumn(word, F.shiftright(F.col(row), 6)).join(F.broadcast(bitmap), word, "inner" if wanted else "left")
    has = F.expr(f"getbit({bits}, cast({row} & 63 AS INT)) = 1")
    return joined.where(has if wanted else F.coalesce(~has, F.lit(True))).select(rows.columns)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body's lambdas use it.

    A plain column used inside a lambda is computed again for each element.
    """
    return F.transform(F.array(value), body)[0]


def spaced(text: Column) -> Column:
    """text with every ASCII white space as a blank; null as empty. Byte searches, no regex."""
    whole = F.coalesce(text, F.lit(""))
    for c in "\t\x0b\x0c\r":
        whole = F.replace(whole, F.lit(c), F.lit(" "))
    return F.replace(whole, F.lit("\n"), F.lit(" "))


def words(text: Column) -> Column:
    """The runs between ASCII white space. A split at one plain character is the quick kind."""
    return F.filter(F.split(spaced(text), " "), lambda w: w != "")
