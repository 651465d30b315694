"""Functions on sound samples held as arrays of numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# How fast an emotion is spoken.
PACE = {"sad": 0.9, "fear": 1.05, "happy": 1.05, "command": 1.05, "anger": 1.1, "surprise": 1.1}


def normalise_peak(samples: Column, peak: float = 0.9) -> Column:
    """Samples scaled to ``peak``; silence stays as it is."""
    top = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return F.when(top > 1e-6, F.transform(samples, lambda x: x / top * peak)).otherwise(samples)


def pace(emotion: Column, usual: float = 1.0) -> Column:
    """Speaking pace of an emotion, between 0.5 and 2."""
    table = F.create_map(*[F.lit(x) for p in PACE.items() for x in p])
    return F.least(F.greatest(F.coalesce(F.try_element_at(table, F.lower(F.trim(emotion))), F.lit(1.0)) * usual, F.lit(0.5)), F.lit(2.0))


def resample(source: int, target: int):
    """A function that changes the rate of samples by linear interpolation."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(samples: pd.Series) -> pd.Series:
        def one(x):
            if x is None or source == target or len(x) == 0:
                return x
            n = max(1, int(len(x) * target / source))
            return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), np.asarray(x, float))

        return samples.map(one)

    return run


def payload_bytes(payload: Column) -> Column:
    """The sound in an answer: base64, with or without the head of a data address."""
    return F.try_to_binary(F.regexp_replace(payload, r"^data:[^,]*,", ""), F.lit("base64"))
