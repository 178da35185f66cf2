"""Functions for SQL: ``register(spark)``, then ``select sw_align(la, lb, ra, rb) ...`` or ``from token_windows_of(275, 60, 10, n)``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellum.operators.align import FIELDS, RESULT, ROWS, align_batch
from vellum.params import Params


def register(spark: SparkSession, p: Params | None = None) -> None:
    """Register ``sw_align``, ``sw_align_weighted`` (two more arrays of weights) and the table function ``token_windows_of``.

    A row without an alignment gets null; so does one with a null array."""
    p = p or Params()
    schema = RESULT

    def rows(arrays, weights):
        cols = [[None if x is None else np.asarray(x, np.int64) for x in a] for a in arrays]
        extra = [[None if x is None else np.asarray(x, np.float32) for x in a] for a in weights] or [None, None]
        whole = [i for i in range(len(cols[0])) if all(c[i] is not None for c in (*cols, *(e for e in extra if e is not None)))]
        out: list[tuple | None] = [None] * len(cols[0])
        for k in range(0, len(whole), ROWS):
            part = whole[k : k + ROWS]
            pick = lambda c: None if c is None else [c[i] for i in part]
            for i, r in zip(part, align_batch(*(pick(c) for c in cols), *(pick(e) for e in extra), p), strict=True):
                out[i] = r
        return pd.DataFrame([dict(zip(FIELDS, r or [None] * len(FIELDS), strict=True)) for r in out], columns=FIELDS).astype({f: "float32" if f == "match_weight_sum" else "Int64" for f in FIELDS})

    def plain(la: pd.Series, lb: pd.Series, ra: pd.Series, rb: pd.Series) -> pd.DataFrame:
        return rows((la, lb, ra, rb), ())

    def weighted(la: pd.Series, lb: pd.Series, ra: pd.Series, rb: pd.Series, wa: pd.Series, wb: pd.Series) -> pd.DataFrame:
        return rows((la, lb, ra, rb), (wa, wb))

    class Windows:
        def eval(self, size: int, stride: int, least: int, length: int):
            start, idx = 0, 0
            while start + size <= length or start == 0 < length or (start < length and length - start >= least):
                yield idx, start, min(start + size, length)
                if start + size > length:
                    break
                start, idx = start + stride, idx + 1

    spark.udf.register("sw_align", F.pandas_udf(plain, schema))
    spark.udf.register("sw_align_weighted", F.pandas_udf(weighted, schema))
    spark.udtf.register("token_windows_of", F.udtf(Windows, returnType="window_idx bigint, global_start bigint, global_end bigint"))
