"""Labels from an external labeler, given as a callable, and their import."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.counting import require_none

SCHEMA = "odino string, status string, attempts int, label string, error string"


def cache_key(id: str = "odino", model: str = "model", prompt: str = "prompt_hash", input: str = "input_hash"):
    """The hash by which a label is known: any other model, prompt or input has another key."""
    return F.sha2(F.concat_ws("|", id, model, prompt, input), 256)


def labelled(todo: DataFrame, labeler: Callable[[str], str], tasks: int = 8, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """Each row's label by the labeler, at most tasks at a time; a failure is tried again after min(2 ** k, 8) waits.

    A row never fails the job: its status is ok or failed, with the last error. Null texts fail without a call.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for odino, text in zip(b["odino"], b["text"]):
                error, label, k = "no text", None, 0
                while text is not None and label is None and k < attempts:
                    try:
                        label = labeler(text)
                    except Exception as x:  # whatever the labeler raises is that row's error
                        error = f"{type(x).__name__}: {x}"[:200]
                        time.sleep(min(2**k, 8) * wait if k + 1 < attempts else 0)
                    k += 1
                rows.append((odino, "failed" if label is None else "ok", k, label, error if label is None else None))
            yield pd.DataFrame(rows, columns=["odino", "status", "attempts", "label", "error"])

    return todo.select("odino", "text").repartition(tasks).mapInPandas(run, SCHEMA)


def undone(cohort: DataFrame, cache: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of a cohort without a good label in the cache, by id, at most so many new ones (None: all)."""
    left = cohort.join(cache.where("status = 'ok'").select("cache_key"), "cache_key", "left_anti").orderBy("odino")
    return left if most is None else left.limit(most)


def complete(cohort: DataFrame, cache: DataFrame) -> DataFrame:
    """The cohort with its labels; raises unless every row has a good one whose id, model, prompt and input are its own.

    Of several records with one key the last holds, by labeled_at.
    """
    same = ["odino", "model", "prompt_hash", "input_hash"]
    last = cache.groupBy("cache_key").agg(F.max_by(F.struct("status", *same, "primary", "secondary"), "labeled_at").alias("l"))
    joined = cohort.select("cache_key", *[F.col(c).alias(f"_{c}") for c in same]).join(last, "cache_key", "left")
    good = F.lit(True)
    for c in same:
        good = good & F.col(f"l.{c}").eqNullSafe(F.col(f"_{c}"))
    require_none(joined.where(~F.coalesce((F.col("l.status") == "ok") & good, F.lit(False))), "labels are missing, failed or stale")
    return joined.select(F.col("_odino").alias("odino"), "l.primary", "l.secondary")
