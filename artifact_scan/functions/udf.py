"""Arrow-batched Python functions on a text column, made when they are first used in a plan."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def on_text(kind: str) -> Callable[[Callable], Callable[[str], Column]]:
    """Decorates a function of one text and more arguments; it becomes a function from a column's name and those to an expression of type ``kind``."""

    def wrap(f: Callable) -> Callable[[str], Column]:
        def expression(column: str, *more) -> Column:
            def run(text: pd.Series) -> pd.Series:
                return text.map(lambda t: f(t or "", *more))

            def run_struct(text: pd.Series) -> pd.DataFrame:
                return pd.DataFrame([f(t or "", *more) for t in text], columns=[c.split(":")[0] for c in kind[7:-1].split(",")])

            run.__annotations__ = {"text": pd.Series, "return": pd.Series}
            run_struct.__annotations__ = {"text": pd.Series, "return": pd.DataFrame}
            return F.pandas_udf(run_struct if kind.startswith("struct<") else run, kind)(column)

        return expression

    return wrap
