"""Many small groups per Arrow batch, for kernels that see one group at a time.

Rows are partitioned by the key and sorted; a partition is read batch by batch and cut where the
key changes, so that a group costs a slice and not a message between processes.  What a task
holds is one batch and one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from quadrat.session import spread

Arrays = dict[str, np.ndarray]


def map_groups(df: DataFrame, key: str, order: list[str | Column], kernel: Callable[[Arrays], Arrays], schema: str) -> DataFrame:
    """``kernel`` over each group of ``key``, its rows sorted by ``order``.

    The kernel gets the columns of a group as arrays and gives those of its result.  NULL keys
    form a group of their own.
    """
    columns = df.columns

    def cut(frame: pd.DataFrame) -> np.ndarray:
        values = frame[key]
        same = (values == values.shift()) | (values.isna() & values.shift().isna())
        begins = np.flatnonzero(~same.to_numpy())
        return begins if len(begins) and begins[0] == 0 else np.concatenate(([0], begins))

    def results(frame: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        arrays = {c: frame[c].to_numpy() for c in columns}
        parts = [kernel({c: v[a:b] for c, v in arrays.items()}) for a, b in zip(bounds[:-1], bounds[1:])]
        return pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            begins = cut(frame)
            last = int(begins[-1])
            if last:
                yield results(frame, begins)
            held = frame.iloc[last:].reset_index(drop=True)
        if held is not None:
            yield results(held, np.array([0, len(held)]))

    return spread(df, key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
