"""Reading and writing: sources by name, JSON lines, metrics, pluggable scorers."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_FORMATS: dict[str, str] = {}


def register_source(spark: SparkSession, name: str, source: type) -> None:
    """Makes a Python data source (a ``pyspark.sql.datasource.DataSource``) readable by ``read_source`` under a name, which may end in .py."""
    spark.dataSource.register(source)
    _FORMATS[name] = source.name()


def split_name(name: str) -> tuple[str, str | None]:
    """``folder@part`` names a part of a folder."""
    base, _, part = name.strip().partition("@")
    return base, part or None


def read_source(spark: SparkSession, name: str, schema: StructType | str | None = None) -> DataFrame:
    """A source by its name: .json and .jsonl (a record a line), .csv (with header), .parquet, .orc, .txt, or a folder of Parquet files.

    ``name@part`` reads a subfolder. A schema spares the inference pass. Scripts are never executed.
    """
    base, part = split_name(name)
    path = os.path.join(base, part) if part else base
    kind = os.path.splitext(path)[1].lower()
    if kind == ".py" or base in _FORMATS:
        if base not in _FORMATS:
            raise ValueError("scripts are not run; register a data source instead")
        source = spark.read.format(_FORMATS[base])
        return (source.option("part", part) if part else source).load()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind in (".json", ".jsonl"):
        return reader.option("mode", "FAILFAST").json(path)
    if kind == ".csv":
        return reader.option("header", True).csv(path)
    if kind == ".orc":
        return reader.orc(path)
    if kind == ".txt":
        return spark.read.text(path)
    return reader.parquet(path)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, single: bool = False) -> None:
    """JSON lines, non-ASCII kept. ``single`` makes one file (for small results); ``order`` sorts globally."""
    out = df.orderBy(*order) if order else df
    (out.coalesce(1) if single else out).write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str, prefix: str, step: int) -> None:
    """Scalar columns of a one-row frame appended as (name, step, value)."""
    pairs = F.array(*[F.struct(F.lit(f"{prefix}/{c}").alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns])
    df.select(F.explode(pairs).alias("m")).select("m.name", F.lit(step).alias("step"), "m.value").write.mode("append").parquet(path)


def score_rows(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], out: str = "score", tries: int = 5, pause: float = 1.0) -> DataFrame:
    """``df`` with a score from a batch scorer (a model service, say), called once an Arrow batch and retried a few times.

    The scorer gets the batch as a pandas frame and returns as many numbers; a wrong count or repeated failure raises.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{out}` double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for attempt in range(tries):
                try:
                    scores = scorer(batch)
                    break
                except Exception:
                    if attempt + 1 == tries:
                        raise
                    time.sleep(pause)
            if len(scores) != len(batch):
                raise ValueError(f"{len(scores)} scores for {len(batch)} rows")
            yield batch.assign(**{out: list(map(float, scores))})

    return df.mapInPandas(run, schema)
