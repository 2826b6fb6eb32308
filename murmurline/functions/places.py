"""Place names to states, offsets and local time."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hour offset from UTC by state code (standard time).
STATE_HOURS = {
    "AK": -9, "AL": -6, "AR": -6, "AZ": -7, "CA": -8, "CO": -7, "CT": -5, "DC": -5, "DE": -5, "FL": -5,
    "GA": -5, "HI": -10, "IA": -6, "ID": -7, "IL": -6, "IN": -5, "KS": -6, "KY": -5, "LA": -6, "MA": -5,
    "MD": -5, "ME": -5, "MI": -5, "MN": -6, "MO": -6, "MS": -6, "MT": -7, "NC": -5, "ND": -6, "NE": -6,
    "NH": -5, "NJ": -5, "NM": -7, "NV": -8, "NY": -5, "OH": -5, "OK": -6, "OR": -8, "PA": -5, "RI": -5,
    "SC": -5, "SD": -6, "TN": -6, "TX": -6, "UT": -7, "VA": -5, "VT": -5, "WA": -8, "WI": -6, "WV": -5,
    "WY": -7,
}

# State and territory names by code.
STATE_NAMES = {
    "AK": "Alaska", "AL": "Alabama", "AR": "Arkansas", "AS": "American Samoa", "AZ": "Arizona",
    "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DC": "District of Columbia", "DE": "Delaware",
    "FL": "Florida", "GA": "Georgia", "GU": "Guam", "HI": "Hawaii", "IA": "Iowa", "ID": "Idaho",
    "IL": "Illinois", "IN": "Indiana", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana",
    "MA": "Massachusetts", "MD": "Maryland", "ME": "Maine", "MI": "Michigan", "MN": "Minnesota",
    "MO": "Missouri", "MP": "Northern Mariana Islands", "MS": "Mississippi", "MT": "Montana",
    "NA": "National", "NC": "North Carolina", "ND": "North Dakota", "NE": "Nebraska",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NV": "Nevada", "NY": "New York",
    "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "PR": "Puerto Rico",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas",
    "UT": "Utah", "VA": "Virginia", "VI": "Virgin Islands", "VT": "Vermont", "WA": "Washington",
    "WI": "Wisconsin", "WV": "West Virginia", "WY": "Wyoming",
}

OTHER = "<Other>"

# Offsets of the four contiguous zones, in seconds, as kept by the hourly job.
US_OFFSETS = (-28800, -14400)


def states(spark: SparkSession) -> DataFrame:
    """Dimension of 57 rows (state, name, tz); territories have a null tz."""
    rows = [(code, name, STATE_HOURS.get(code)) for code, name in STATE_NAMES.items()]
    return spark.createDataFrame(rows, "state string, name string, tz int")


def state_of(place: Column) -> Column:
    """State code of a place label, ``<Other>`` when there is none."""
    by_name = F.create_map(*[F.lit(v) for v in chain.from_iterable(
        (name, code) for code, name in STATE_NAMES.items())])
    full_name = F.substring(place, F.lit(1), F.greatest(F.length(place) - 5, F.lit(0)))
    last_two = F.right(place, F.lit(2))
    return (F.when(place.contains("USA"), F.coalesce(F.try_element_at(by_name, full_name), F.lit(OTHER)))
             .when(last_two.isin(*STATE_NAMES), last_two)
             .otherwise(OTHER))


def state_hours(state: Column) -> Column:
    """Hour offset of a state code; unknown codes and territories count as 0."""
    hours = F.create_map(*[F.lit(v) for v in chain.from_iterable(STATE_HOURS.items())])
    return F.coalesce(F.try_element_at(hours, state), F.lit(0))


def shifted(ts: Column, amount: Column, unit: str) -> Column:
    return F.timestamp_add(unit, amount, ts)


def with_local_time_by_state(df: DataFrame, ts: str = "created_at", place: str = "place") -> DataFrame:
    """State, offset and local time of placed tweets; rows without a state go."""
    return (df.withColumn("location", state_of(F.col(place).cast("string")))
              .where(F.col("location") != OTHER)
              .withColumn("tz", state_hours(F.col("location")))
              .withColumn("local_time", shifted(F.col(ts), F.col("tz"), "HOUR")))


def with_local_time_by_offset(df: DataFrame, ts: str = "created_at", offset: str = "utc_offset") -> DataFrame:
    """Rows of the four contiguous zones with their local time."""
    low, high = US_OFFSETS
    return (df.where(F.col(offset).between(low, high))
              .withColumn("local_time", shifted(F.col(ts), F.col(offset), "SECOND")))
