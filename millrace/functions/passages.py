"""Table functions that cut texts and conversations into overlapping passages, for models that read so much at a time.

`passages(text, size, step)` is called laterally, a row of documents at a time. `turn_passages` takes a table
argument, `PARTITION BY` conversation and `ORDER BY` turn, and holds no more than one passage of turns.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@udtf(returnType="passage_no int, first_word int, passage string")
class Passages:
    """Passages of `size` words, one every `step`; the last one reaches the end. A null text, or one without words, has none."""

    def eval(self, text: str, size: int, step: int) -> Iterator[tuple]:
        if size < 1 or step < 1 or step > size:
            raise ValueError("passages take 1 <= step <= size")
        words = (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        last = max(0, -(-(len(words) - size) // step))
        for i in range(last + 1 if words else 0):
            yield i, i * step, " ".join(words[i * step : i * step + size])


@udtf(returnType="conv_id long, first_turn long, last_turn long, passage string")
class TurnPassages:
    """Each `size` turns in a row of a conversation; all of them together, if there are fewer."""

    def __init__(self):
        self.held: deque = deque()
        self.given = False

    def eval(self, row: Row, size: int) -> Iterator[tuple]:
        self.held.append((row["conv_id"], row["turn"], row["role"], row["text"]))
        if len(self.held) == size:
            yield self._passage()
            self.held.popleft()
            self.given = True

    def terminate(self) -> Iterator[tuple]:
        if self.held and not self.given:
            yield self._passage()

    def _passage(self) -> tuple:
        said = "\n".join(f"{role or ''}: {text or ''}" for _, _, role, text in self.held)
        return self.held[0][0], self.held[0][1], self.held[-1][1], said


def registered(spark: SparkSession) -> None:
    """Makes both functions known to SQL."""
    spark.udtf.register("passages", Passages)
    spark.udtf.register("turn_passages", TurnPassages)


def of_documents(docs: DataFrame, size: int, step: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, passage_no, first_word, passage)."""
    table = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text")).alias("d")
    return table.lateralJoin(Passages(F.col("_text").outer(), F.lit(size), F.lit(step)).alias("p")).drop("_text")


def of_conversations(turns: DataFrame, size: int) -> DataFrame:
    """(conv_id, first_turn, last_turn, passage)."""
    return TurnPassages(turns.select("conv_id", "turn", "role", "text").asTable().partitionBy("conv_id").orderBy("turn"), F.lit(size))
