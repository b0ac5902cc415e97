"""python -m tidemark.console DIR: reads one statement per line and prints rows, until exit."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.errors import PySparkException

from tidemark.plans.sql import ParseError, query
from tidemark.session import get_session
from tidemark.sources.tables import register_views


def show(df: DataFrame, out=None, width: int = 25) -> int:
    """Rows as they come from the partitions, one partition in memory at a time."""
    cell = lambda x: ("NULL" if x is None else str(x))[:width].ljust(width)
    print(" ".join(map(cell, df.columns)), file=out)
    n = 0
    for n, row in enumerate(df.toLocalIterator(), 1):  # noqa: B007
        print(" ".join(map(cell, row)), file=out)
    print(f"{n} rows returned.", file=out)
    return n


def main(folder: str) -> None:
    spark = get_session()
    register_views(spark, folder)
    for line in sys.stdin:
        text = line.strip()
        if text.lower() == "exit":
            break
        try:
            if text:
                show(query(spark, text))
        except (ParseError, PySparkException) as e:
            print(f"error: {e}")


if __name__ == "__main__":
    main(sys.argv[1])
