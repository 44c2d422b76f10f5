"""Model runners behind a UDF boundary: loaded once per partition, failures become invalid rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class ModelRunner(Protocol):
    def load(self) -> None: ...
    def warmup(self) -> None: ...
    def infer(self, items: list) -> list[list[float]]: ...
    def health(self) -> dict: ...
    def close(self) -> None: ...


OBSERVATION = "item_id long, p array<double>, valid boolean, reason string"


def health(observations: DataFrame) -> DataFrame:
    """status (ok or the reason), n: how many observations a model gave and why others are invalid."""
    return observations.groupBy(F.when(F.col("valid"), "ok").otherwise(F.col("reason")).alias("status")).agg(F.count("*").alias("n"))


def observed(observations: DataFrame, reasons: Sequence[str], name: str = "health") -> tuple[DataFrame, Observation]:
    """observations with counters that are taken while they pass, in a batch or a stream: health_of() has them after an action, a stream's progress after each batch.

    reasons: those with a counter of their own; all others are counted together.
    """
    seen = Observation(name)
    reason = F.coalesce(F.col("reason"), F.lit(""))
    each = [F.count_if(~F.col("valid") & (reason == r)).alias(f"reason_{i}") for i, r in enumerate(reasons)]
    other = F.count_if(~F.col("valid") & ~reason.isin(*reasons)).alias("other")
    return observations.observe(seen, F.count_if(F.col("valid")).alias("ok"), *each, other), seen


def health_of(counters: dict, reasons: Sequence[str]) -> list[tuple[str, int]]:
    """(status, n) of observed() counters that are not zero."""
    found = [("ok", counters["ok"]), *((r, counters[f"reason_{i}"]) for i, r in enumerate(reasons)), ("other", counters["other"])]
    return [(status, int(n)) for status, n in found if n]


def score(rows: DataFrame, factory: Callable[[], ModelRunner], item_col: str, id_col: str = "item_id", batch: int = 64) -> DataFrame:
    """OBSERVATION rows. An exception of the runner gives valid = false and its name as reason; no task fails."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner, trouble = None, None
        try:
            runner = factory()
            runner.load()
            runner.warmup()
        except Exception as e:
            trouble = f"load: {type(e).__name__}"
        try:
            for pdf in batches:
                ids, items = pdf.iloc[:, 0].tolist(), pdf.iloc[:, 1].tolist()
                out = []
                for at in range(0, len(ids), batch):
                    part, names = items[at : at + batch], ids[at : at + batch]
                    try:
                        if trouble:
                            raise RuntimeError
                        out += [(i, list(map(float, p)), True, None) for i, p in zip(names, runner.infer(part), strict=True)]
                    except Exception as e:
                        out += [(i, None, False, trouble or f"infer: {type(e).__name__}") for i in names]
                yield pd.DataFrame(out, columns=["item_id", "p", "valid", "reason"])
        finally:
            if runner is not None:
                runner.close()

    return rows.select(id_col, item_col).mapInPandas(run, OBSERVATION)
