"""Tree of classifiers: the predicted label picks the next one (M9)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmurline.session import cut_lineage


@dataclass
class Taxonomy:
    """A node with its classifier, the names of its labels and child nodes by label."""

    name: str
    names: dict[int, str]
    model: PipelineModel
    children: dict[int, "Taxonomy"] = field(default_factory=dict)

    def add_children(self, children: dict[int, "Taxonomy"]) -> "Taxonomy":
        self.children = children
        return self

    def _named(self) -> Column:
        table = F.create_map(*[F.lit(v) for pair in self.names.items() for v in pair])
        return F.try_element_at(table, F.col("label"))

    def predict(self, df: DataFrame, deep: bool = False) -> DataFrame:
        """Adds ``label`` and ``label_name``.

        Shallow, every row has this node's label. Deep, rows of a label with a
        child carry the child's answer; each level scores only its own rows.
        """
        here = (self.model.transform(df).select(*df.columns, F.col("prediction").cast("int").alias("label"))
                .withColumn("label_name", self._named()))
        if not deep or not self.children:
            return here
        here = cut_lineage(here, f"taxonomy-{self.name}")  # one run of this model for all branches
        out = here.where(~F.col("label").isin(*self.children))
        for label, child in self.children.items():
            out = out.unionByName(child.predict(here.where(F.col("label") == label).select(*df.columns), deep=True))
        return out
