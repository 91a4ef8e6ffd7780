"""Files for queries that read files: each row of (name, content) becomes one, written by tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.byte_ranges import place


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """The number of files written to a folder that all tasks reach."""

    @F.pandas_udf("int")
    def write(names: pd.Series, contents: pd.Series) -> pd.Series:
        system, top = place(folder)
        system.create_dir(top, recursive=True)
        for own, text in zip(names, contents, strict=True):
            with system.open_output_stream(f"{top}/{own}") as out:
                out.write(text.encode())
        return pd.Series([1] * len(names), dtype="int32")

    return rows.select(write(name, content).alias("n")).agg(F.sum("n")).first()[0] or 0
