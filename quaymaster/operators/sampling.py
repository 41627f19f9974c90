"""Deterministic stratified sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quaymaster import constants as K
from quaymaster.operators.mapping import ROW_IDX


def sample_indexes(total: int, n: int = K.DRY_RUN_SAMPLE, edge: int = K.SAMPLE_EDGE) -> list[int]:
    """First and last ten, evenly stepped ones, then the smallest unused indexes."""
    if total <= n:
        return list(range(total))
    chosen = set(range(edge)) | set(range(total - edge, total))
    step = total // (n - len(chosen))
    for i in range(0, total, step):
        if len(chosen) >= n:
            break
        chosen.add(i)
    unused = 0
    while len(chosen) < n:
        chosen.add(unused)
        unused += 1
    return sorted(chosen)


def stratified_sample(df: DataFrame, n: int = K.DRY_RUN_SAMPLE, total: int | None = None,
                      row_idx: str = ROW_IDX) -> DataFrame:
    """At most ``n`` rows by dense row index; one number (the row count) reaches the driver."""
    if total is None:
        total = (df.agg(F.max(row_idx)).first()[0] or -1) + 1 if n > 0 else 0
    if total <= n:
        return df
    return df.filter(F.col(row_idx).isin(sample_indexes(total, n)))
