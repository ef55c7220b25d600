"""Vectorised functions that can be defined before a session is there."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(kind: str) -> Callable:
    """A pandas UDF of a DDL type, made when it is used."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, returnType=kind)(*columns)

        return call

    return wrap
