"""Where models and outside services plug in: a protocol, a deterministic stub, and the frames around a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Recognizer(Protocol):
    """A model that is loaded once for each worker and reads a batch of line images."""

    def predict(self, crops: list[bytes]) -> list[tuple[str, float]]: ...


class StubRecognizer:
    """Reads nothing: names each crop by its size. For tests and dry runs."""

    def predict(self, crops: list[bytes]) -> list[tuple[str, float]]:
        return [(f"line of {len(c)} bytes", round(min(0.99, len(c) / (len(c) + 100)), 3)) for c in crops]


def recognize(lines: DataFrame, make: Callable[[], Recognizer], batch: int = 16) -> DataFrame:
    """lines (with data) with text and conf. Arrow batches feed the model in mini-batches; the model is made once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            data = [bytes(x) for x in pdf["data"]]
            out = [r for i in range(0, len(data), batch) for r in model.predict(data[i : i + batch])]
            yield pdf.drop(columns="data").assign(text=[r[0] for r in out], conf=[r[1] for r in out])

    kept = ", ".join(f"`{n}` {t}" for n, t in lines.dtypes if n != "data")
    return lines.mapInPandas(run, f"{kept}, text string, conf double")


def two_tier(lines: DataFrame, fast: Callable[[], Recognizer], slow: Callable[[], Recognizer], enough: float = 0.82) -> DataFrame:
    """The fast model's reading where it is sure enough, else the slow one's; the slow one sees no other lines."""
    read = recognize(lines.withColumn("_d", F.col("data")), fast).withColumnRenamed("_d", "data")
    unsure = read.filter(F.col("conf") < enough).drop("text", "conf")
    return read.filter(F.col("conf") >= enough).drop("data").unionByName(recognize(unsure, slow))


def request_chunks(lines: DataFrame, group: str, order: str, size: int = 30) -> DataFrame:
    """lines with chunk and place in it: what one call to a service is sent."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return lines.withColumn("chunk", F.floor(n / size).cast("int")).withColumn("place", (n % size).cast("int"))


def resolved(corrections: DataFrame, lines: DataFrame, group: list[str], value: str = "corrected_text") -> DataFrame:
    """group, line_index, value of a service's corrections (group, pos, raw, value) of lines (group, place, line_index).

    raw, or pos where it is null, is the line's own index if the group has it, else a place in the group; if it is neither, pos is
    the place. Corrections of no line go; of several of one line the last by pos stays. A group is what one call is sent
    (request_chunks), so its indices fit in a row."""
    index = F.transform(F.sort_array(F.collect_list(F.struct("place", "line_index"))), lambda x: x["line_index"])
    d = corrections.join(lines.groupBy(*group).agg(index.alias("_index")), group).withColumn("_raw", F.coalesce("raw", "pos"))
    at = F.when(F.array_contains("_index", F.col("_raw")), F.col("_raw")).otherwise(F.coalesce(F.get("_index", F.col("_raw")), F.get("_index", F.col("pos"))))
    return d.withColumn("line_index", at).filter("line_index is not null").groupBy(*group, "line_index").agg(F.max_by(value, "pos").alias(value))


def merge_corrections(lines: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """lines (text, conf) with corrected_text, changed and conf raised by 0.12 to 0.98 where a correction changed it."""
    d = lines.join(corrections.select(*keys, F.col("corrected_text").alias("_c")), keys, "left")
    text = F.coalesce("_c", "text")
    changed = F.lower(F.trim(text)) != F.lower(F.trim("text"))
    return d.select(*lines.columns[:-1] if lines.columns[-1] == "conf" else [c for c in lines.columns if c != "conf"], text.alias("corrected_text"), changed.alias("changed"), F.when(changed, F.least(F.lit(0.98), F.col("conf") + 0.12)).otherwise(F.col("conf")).alias("conf"))


def study_kit_fallback(lines: DataFrame, group: str, order: str) -> DataFrame:
    """One flashcard of the first three lines, where no service answers."""
    first = F.slice(F.sort_array(F.collect_list(F.struct(order, "text"))), 1, 3)
    return lines.groupBy(group).agg(F.array_join(F.transform(first, lambda x: x["text"]), " ").alias("answer")).withColumn("question", F.lit("What do these notes start with?"))
