"""Crowd answers to labels and label selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurline.functions.scores import fold_heavy

# Answer strings of the crowd form and what they mean.
NOT_RELATED = "Not Alcohol Related"
FIRST_PERSON_LEVEL = {
    "First Person - Alcohol": 0,
    "First Person - Alcohol::Casual Drinking": 0,
    "First Person - Alcohol::Looking to drink": 1,
    "First Person - Alcohol::Reflecting on drinking": 2,
    "First Person - Alcohol::Heavy Drinking": 0,
}
RELATED_KIND = {
    "Alcohol Related::Discussion": 0,
    "Alcohol Related::Promotional Content": 1,
}
CONSUMPTION_PREFIX = "Alcohol Consumption"


def _code(answer: Column, table: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), answer)


def parse_answer(answer: Column) -> Column:
    """Label struct of a crowd answer; null for a string outside the form."""
    none_int, none_str = F.lit(None).cast("int"), F.lit(None).cast("string")

    def labels(alcohol, person=none_int, level=none_int, related=none_int, raw=none_str) -> Column:
        return F.struct(F.lit(alcohol).cast("int").alias("alcohol"), person.cast("int").alias("first_person"),
                        level.cast("int").alias("first_person_level"),
                        related.cast("int").alias("alcohol_related"), raw.alias("raw"))

    return (F.when(answer == NOT_RELATED, labels(0))
             .when(answer.startswith(CONSUMPTION_PREFIX), labels(1))
             .when(answer.isin(*FIRST_PERSON_LEVEL),
                   labels(1, F.lit(1), _code(answer, FIRST_PERSON_LEVEL)))
             .when(answer.isin(*RELATED_KIND),
                   labels(1, F.lit(0), none_int, _code(answer, RELATED_KIND), answer)))


def parse_answers(results: DataFrame, answer: str = "Answer") -> tuple[DataFrame, DataFrame]:
    """Labelled rows and rows whose answer is unknown; empty answers are dropped."""
    filled = results.where(F.col(answer) != "{}").withColumn("labels", parse_answer(F.col(answer)))
    return filled.where(F.col("labels").isNotNull()), filled.where(F.col("labels").isNull()).drop("labels")


class LabelSelector:
    """Rows that carry a given label, with the label as column ``y``."""

    def __init__(self, df: DataFrame, column: str = "labels"):
        self.df = df
        self.column = column

    def _having(self, name: str) -> DataFrame:
        y = F.col(f"{self.column}.{name}")
        return self.df.where(y.isNotNull()).withColumn("y", y)

    def alcohol(self) -> DataFrame:
        return self._having("alcohol")

    def first_person(self) -> DataFrame:
        return self._having("first_person")

    def first_person_level(self) -> DataFrame:
        return self._having("first_person_level").withColumn("y", fold_heavy(F.col("y")))

    def flat(self) -> DataFrame:
        level, alcohol = F.col(f"{self.column}.first_person_level"), F.col(f"{self.column}.alcohol")
        return self.df.withColumn("y", F.coalesce(level + 2, alcohol))
