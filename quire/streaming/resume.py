"""Translation in resumable micro-batches.

A provider is any callable from a list of texts to a list of as many translations.
State is a table of versions keyed by segment; a micro-batch that is run again
writes the same keys, and readers take the latest version of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import state as S
from ..plans.blocks import small_batches

MAX_DEPTH = 8


class SplitError(Exception):
    """A failed batch that may succeed in halves."""


class RateLimited(Exception):
    """Never split: the next call would fail too."""


def stub_provider(texts: list[str]) -> list[str]:
    """A deterministic stand-in for a model."""
    return [f"[{len(t)}] {t[::-1]}" for t in texts]


def call(provider: Callable[[list[str]], list[str]], texts: list[str], depth: int = 0) -> list[str]:
    """One call, or two halves when it fails in a way that splitting may mend."""
    try:
        out = provider(texts)
        if len(out) != len(texts) or any(not str(x).strip() for x in out):
            raise SplitError(f"{len(out)} usable replies for {len(texts)} texts")
        return out
    except SplitError:
        if len(texts) == 1 or depth >= MAX_DEPTH:
            raise
        half = len(texts) // 2
        return call(provider, texts[:half], depth + 1) + call(provider, texts[half:], depth + 1)


def translate(planned: DataFrame, provider: Callable[[list[str]], list[str]] = stub_provider) -> DataFrame:
    """Adds ``translated`` to rows of book, batch_id, ord and text, one provider call a
    batch. Rows are streamed in order of batch: a task holds one batch at a time,
    and a batch is bounded by its plan."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def done(batch: pd.DataFrame) -> pd.DataFrame:
            return batch.assign(translated=call(provider, [t or "" for t in batch["text"]]))

        for part in parts:
            whole = part if held is None else pd.concat([held, part], ignore_index=True)
            number = whole.groupby(["book", "batch_id"], sort=False, dropna=False).ngroup()
            last = number.iloc[-1] if len(whole) else -1
            for _, batch in whole[number != last].groupby(number[number != last], sort=False):
                yield done(batch)
            held = whole[number == last]
        if held is not None and len(held):
            yield done(held)

    small_batches(planned.sparkSession)
    rows = planned.select("book", "batch_id", "ord", "text").repartition("book", "batch_id").sortWithinPartitions("book", "batch_id", "ord")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, translated string")


def resume_stream(stream: DataFrame, state_path: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame]):
    """Runs work on each micro-batch's rows that have no state yet and appends its
    result as a new version. ``availableNow``: ends when the input is used up."""

    def commit(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(state_path)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        todo = S.pending(rows, spark.read.parquet(state_path).filter(F.col("version") < epoch), key) if there else rows
        # a folder for each epoch, replaced when the epoch is run again
        work(todo).write.mode("overwrite").parquet(f"{state_path}/version={epoch}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(state: DataFrame, key: str) -> DataFrame:
    """The latest version of each segment's state."""
    columns = [c for c in state.columns if c != key]
    return state.groupBy(key).agg(F.max_by(F.struct(*columns), "version").alias("s")).select(key, "s.*")
