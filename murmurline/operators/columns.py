"""Column selection and clean-up of whole frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; the scan reads no others."""
    return df.select(*names)


def exploded_records(df: DataFrame, **fields: list[str]) -> DataFrame:
    """Named sub-fields of struct columns as ``column.field`` columns."""
    for column, subs in fields.items():
        df = df.withColumns({f"{column}.{s}": F.col(column).getField(s) for s in subs})
    return df


#: Forms a time may have besides the ISO one: as the posts' source writes it, month first, and with a month name.
TIME_FORMS = ("E MMM dd HH:mm:ss Z yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "dd MMM yyyy HH:mm:ss", "dd MMM yyyy")


def parsed_timestamps(df: DataFrame, column: str, forms: tuple[str, ...] = TIME_FORMS) -> DataFrame:
    """Parse a timestamp column in the first form that fits, dropping rows that do not parse (P5).

    Times with an offset become UTC; others are taken as they stand.
    """
    text = F.col(column).cast("string")
    # a weekday is checked by no parser in use here, so it is cut off
    plain = F.regexp_replace(text, r"^[A-Za-z]{3} (?=[A-Za-z]{3} )", "")
    tries = [F.try_to_timestamp(plain, F.lit(f.removeprefix("E "))).cast("timestamp_ntz") for f in forms]
    return df.withColumn(column, F.coalesce(F.expr(f"try_cast(`{column}` AS timestamp_ntz)"), *tries)).where(F.col(column).isNotNull())
