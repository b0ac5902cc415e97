"""Python functions of one text column. The other columns stay in the JVM as they are, whatever their types: 64-bit numbers
beside nulls would come out of a data frame rounded.

The functions give the same for the same, but are declared not to: the planner would run them a second time for each
filter on what they give, on the way to the scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

from tidemark.llm.common import tidy


def of_texts(run: Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]], schema: str) -> Callable:
    """A column function: run gets batches of texts and gives rows of schema, one for each text, in any batches."""

    def inner(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(run)(batches)

    return F.pandas_udf(inner, schema).asNondeterministic()


def of_numbers(run: Callable[[pd.Series, pd.Series], pd.DataFrame], schema: str) -> Callable:
    """The same for two columns of numbers."""

    def inner(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return run(a, b)

    return F.pandas_udf(inner, schema).asNondeterministic()
