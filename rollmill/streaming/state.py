"""Stateful pieces: adaptive KL coefficient and bounded buffer, in batch and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def kl_factor(current: Column, n_steps: Column, target: float, horizon: float) -> Column:
    """What one update multiplies the coefficient by."""
    error = F.least(F.greatest(current / target - 1, F.lit(-0.2)), F.lit(0.2))
    return 1 + error * n_steps / horizon


def adaptive_coefficient(df: DataFrame, current: str, n_steps: Column, start: float, target: float, horizon: float, by: str | None = None) -> DataFrame:
    """The coefficient after all updates, per group: updates only multiply, so their order doesn't matter and one aggregate does."""
    grouped = df.groupBy(by) if by else df.groupBy()
    factor = F.product(kl_factor(F.col(current), n_steps, target, horizon))
    return grouped.agg((F.lit(start) * F.coalesce(factor, F.lit(1.0))).alias("coefficient"), F.count("*").alias("n_updates"))


def fixed_coefficient(df: DataFrame, value: float) -> DataFrame:
    return df.withColumn("coefficient", F.lit(value))


def bounded_buffer(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The newest ``limit`` rows by ``order``; all for a limit <= 0."""
    return df.orderBy(F.desc(order)).limit(limit) if limit > 0 else df


def cyclic(df: DataFrame, position: str, total: int, steps: int) -> DataFrame:
    """Step t of an endless iteration over the rows takes the row at t modulo total."""
    rounds = -(-steps // total)
    return df.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("step", F.col("_round") * total + F.col(position)).where(F.col("step") < steps).drop("_round")


def stream_coefficient(stream: DataFrame, key: str, current: str, n_steps: str, start: float, target: float, horizon: float) -> DataFrame:
    """The running coefficient of every key of a stream, one row a key and micro-batch. State: one number a key."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else start
        for pdf in batches:
            for c, n in zip(pdf[current], pdf[n_steps]):
                value *= 1 + min(max(c / target - 1, -0.2), 0.2) * n / horizon
        state.update((value,))
        yield pd.DataFrame({key: [k[0]], "coefficient": [value]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, coefficient double", "value double", "update", GroupStateTimeout.NoTimeout)


def stream_buffer(stream: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """The ids of the newest ``limit`` rows of every key, sent anew for every micro-batch in which the key occurs. State: ``limit`` ids a key."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for pdf in batches:
            held = sorted([*held, *map(int, pdf[order])])[-limit:] if limit > 0 else sorted([*held, *map(int, pdf[order])])
        state.update((held,))
        yield pd.DataFrame({key: [k[0]] * len(held), "held": held})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, held bigint", "held array<bigint>", "update", GroupStateTimeout.NoTimeout)


def resume_from(df: DataFrame, position: str, consumed: int, total: int) -> DataFrame:
    """``df`` as seen when training goes on after ``consumed`` samples: ``epoch`` of each row still to come first, and ``order`` within the rest.

    Whole epochs are over; of the current one the first ``consumed % total`` rows have been used and come again in the next epoch only.
    """
    done, used = divmod(consumed, total) if total else (0, 0)
    later = F.col(position) < used
    return df.withColumn("epoch", F.lit(done) + later.cast("int")).withColumn("order", F.when(later, F.col(position) + total - used).otherwise(F.col(position) - used))


def rollout_loop(stream: DataFrame, folder: str, score, train, limit: int, order: str):
    """A started query: every micro-batch is scored, buffered, trained on and cleared, and its offsets are kept, so that it resumes.

    ``score(df)`` gives the batch its columns, ``train(df, batch_id)`` uses the newest ``limit`` rows by ``order`` and must be idempotent
    for a batch id, as a batch may be repeated after a failure. Offsets are in ``folder``, which all machines must share.
    """

    def turn(batch: DataFrame, number: int) -> None:
        held = score(batch).persist()
        try:
            train(bounded_buffer(held, order, limit), number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(turn).option("checkpointLocation", folder).start()


def coalesced_requests(df: DataFrame, actor: str, actors: int, engines: int) -> DataFrame:
    """``df`` of requests with ``engine`` and ``ready``: engine e serves the actors that leave the rest e, and runs once all of them have sent.

    ``ready`` tells whether every actor of the engine is in the table; one row an engine is joined back.
    """
    rows = df.withColumn("engine", F.pmod(F.col(actor), F.lit(engines)).cast("int"))
    wanted = F.floor((F.lit(actors - 1) - F.col("engine")) / engines) + 1
    sent = rows.groupBy("engine").agg(F.count_distinct(actor).alias("_sent"))
    return rows.join(F.broadcast(sent), "engine").withColumn("ready", F.col("_sent") == wanted).drop("_sent")


def moving_average(df: DataFrame, name: str, step: str, value: str, beta: float = 0.992) -> DataFrame:
    """``name`` and ``average``: the exponential average of every named number over its steps, the first of which starts it.

    ema = beta * ema + (1 - beta) * value. Weights of the steps depend on their distance from the last one only, so one aggregate does.
    """
    last = df.groupBy(name).agg(F.max(step).alias("_last"), F.min(step).alias("_first"), F.count("*").alias("_n"))
    rows = df.join(last, name)
    weight = F.pow(F.lit(beta), F.col("_last") - F.col(step)) * F.when(F.col(step) == F.col("_first"), F.lit(1.0)).otherwise(F.lit(1.0 - beta))
    return rows.groupBy(name).agg(F.sum(weight * F.col(value)).alias("average"))
