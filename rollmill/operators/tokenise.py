"""Texts to token ids by a pluggable tokenizer, batches of arrays, and outputs of engines in rectangular or packed form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions import arrays as A

#: A tokenizer: a list of texts to a list of id lists.
Encode = Callable[[list[str]], list[list[int]]]


def byte_tokens(texts: list[str]) -> list[list[int]]:
    """The plainest tokenizer: one token a UTF-8 byte."""
    return [list(t.encode()) for t in texts]


def pad_id(pad: Column | int | None, eos: Column | int) -> Column:
    """The padding token, by default the one that ends texts."""
    return F.coalesce(pad if isinstance(pad, Column) else F.lit(pad).cast("int"), eos if isinstance(eos, Column) else F.lit(eos))


def tokenise(df: DataFrame, text: str, encode: Encode = byte_tokens, max_length: int | None = None, ids: str = "ids", length: str = "n_ids", side: str = "right") -> DataFrame:
    """``df`` with token ids and the untruncated length of ``text``, an Arrow batch at a time.

    Ids beyond ``max_length`` are cut at the end (``side`` "left": at the beginning). A NULL text has NULL ids and length; an empty one none.
    """
    kept = [f for f in df.schema.fields if f.name not in (ids, length)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{ids}` array<int>", f"`{length}` int"])
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            there = batch[text].notna().to_numpy()
            found = iter(encode(batch[text][there].tolist()))
            own = [list(next(found)) if t else None for t in there]
            batch = batch[names].copy()
            cut = (lambda x: x) if max_length is None else (lambda x: x[:max_length] if side == "right" else x[max(0, len(x) - max_length) :])
            batch[ids] = pd.Series([None if x is None else cut(x) for x in own], index=batch.index, dtype=object)
            batch[length] = pd.array([None if x is None else len(x) for x in own], dtype="Int32")
            yield batch

    return df.select(*names).mapInPandas(run, schema)


def judge_inputs(df: DataFrame, text: str, encode: Encode, max_new: int, pad: int, prompt_length: Column | None = None, ids: str = "ids", batch: str | None = None) -> DataFrame:
    """``df`` with token ids of judge inputs, cut to ``max_new`` (plus the prompt's length, for steps), padded on the right, and ``mask``.

    Rows are padded to the longest of their ``batch``, or of the whole table without one: one number is joined back, no row is gathered.
    """
    rows = tokenise(df, text, encode, None, ids, "_n")
    limit = F.lit(max_new) + (prompt_length if prompt_length is not None else F.lit(0))
    rows = rows.withColumn(ids, F.slice(ids, F.lit(1), F.least(F.size(ids), limit).cast("int"))).drop("_n")
    widest = rows.groupBy(*([batch] if batch else [])).agg(F.max(F.size(ids)).alias("_width"))
    rows = rows.join(widest, batch) if batch else rows.crossJoin(F.broadcast(widest))
    mask = A.pad(F.transform(ids, lambda _: F.lit(1)), F.col("_width"), 0, "right")
    return rows.withColumn("mask", mask).withColumn(ids, A.pad(F.col(ids), F.col("_width"), pad, "right")).drop("_width")


def collate(df: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """One row a batch: an array of each column, all in the order of ``order``. Batches are small by construction."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(c).alias(c) for c in columns])))
    grouped = df.groupBy(batch).agg(rows.alias("_rows"), F.count("*").alias("n_rows"))
    return grouped.select(batch, "n_rows", *[F.col("_rows").getField(c).alias(c) for c in columns])


def uncollate(df: DataFrame, batch: str, columns: list[str], place: str = "place") -> DataFrame:
    """The rows of collated batches again, numbered from 0 within their batch."""
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in columns])
    return df.select(batch, F.posexplode(zipped).alias(place, "_r")).select(batch, place, *[F.col(f"_r.{c}").alias(c) for c in columns])


def closed(output: Column, eos: int) -> Column:
    """An output that ends in the end token, which is appended where it's missing."""
    return F.when(F.try_element_at(output, F.lit(-1)) == eos, output).otherwise(F.concat(output, F.array(F.lit(eos))))


def last_is(ids: Column, eos: int) -> Column:
    """The ids with the last one replaced by the end token; an empty array stays."""
    return F.when(F.size(ids) > 0, F.concat(F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))), F.array(F.lit(eos)))).otherwise(ids)


def rectangle(df: DataFrame, batch: str, prompt: str, output: str, eos: int, pad: int) -> DataFrame:
    """``df`` with ``sequence``, ``attention`` and ``n_actions``: prompts padded on the left and closed outputs on the right, to the longest of
    their batch. The widths of a batch are one row, joined back."""
    rows = df.withColumn("_out", closed(F.col(output), eos))
    widths = rows.groupBy(batch).agg(F.max(F.size(prompt)).alias("_p"), F.max(F.size("_out")).alias("_o"))
    rows = rows.join(widths, batch)
    sequence = F.concat(A.pad(F.col(prompt), F.col("_p"), pad, "left"), A.pad(F.col("_out"), F.col("_o"), pad, "right"))
    return rows.withColumn("sequence", sequence).withColumn("attention", A.attention_mask(sequence, F.col("_p"), eos, pad)).withColumn("n_actions", F.col("_o")).drop("_out", "_p", "_o")


def packed_rows(df: DataFrame, batch: str, order: str, prompt: str, output: str, eos: int) -> DataFrame:
    """One row a batch: all prompts with their closed outputs end to end, ``segments`` (1-based), ``lengths`` and ``n_actions`` (at least 1 each)."""
    whole = df.select(batch, order, F.concat(F.col(prompt), closed(F.col(output), eos)).alias("_s"), F.greatest(F.lit(1), F.size(closed(F.col(output), eos))).alias("_a"))
    held = collate(whole, batch, order, ["_s", "_a"])
    return held.select(batch, A.pack(F.col("_s")).alias("sequence"), A.segments(F.col("_s")).alias("segments"), F.transform("_s", lambda s: F.size(s)).alias("lengths"), F.col("_a").alias("n_actions"))
