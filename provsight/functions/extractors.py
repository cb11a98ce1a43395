"""Interchangeable extractors: from statements to the names that they use. parity in operators.reconcile compares two."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text


class Extractor(Protocol):
    def owners(self, df: DataFrame) -> DataFrame: ...

    def intents(self, df: DataFrame) -> DataFrame: ...


class PatternExtractor:
    """All anchors."""

    def __init__(self, key: str, body: str = "body", anchors=text.ANCHORS):
        self.key, self.body, self.anchors = key, body, anchors

    def owners(self, df: DataFrame) -> DataFrame:
        return text.extract_owner(df, self.body, detail=True).where("owner_db IS NOT NULL").select(self.key, "owner_db", "owner_name", "owner_kind", "specific_db", "specific_name")

    def reads(self, df: DataFrame) -> DataFrame:
        """Distinct (key, ref_db, ref_name) of what is read."""
        return self._by_intent(df, "read").drop("privilege").distinct()

    def writes(self, df: DataFrame) -> DataFrame:
        """Distinct (key, ref_db, ref_name, privilege) of what is written."""
        return self._by_intent(df, "write")

    def calls(self, df: DataFrame) -> DataFrame:
        """Distinct (key, ref_db, ref_name, privilege) of what is called."""
        return self._by_intent(df, "call")

    def _by_intent(self, df: DataFrame, intent: str) -> DataFrame:
        return text.extract_intents(df, self.key, self.body).where(F.col("intent") == intent).drop("intent")

    def intents(self, df: DataFrame) -> DataFrame:
        refs = text.extract_refs(df, self.key, self.body, self.anchors).where("privilege != ''")
        return refs.select(self.key, "ref_db", "ref_name", F.explode(F.split("privilege", ",")).alias("privilege")).distinct()


def register(spark: SparkSession) -> None:
    """mask_noise(text) and split_statements(text) as vectorised functions of SQL."""
    blank, pieces = text.blank_noise, text.split_text
    spark.udf.register("mask_noise", F.pandas_udf(lambda s: s.map(lambda t: None if t is None else blank(t)), "string"))
    spark.udf.register("split_statements", F.pandas_udf(lambda s: s.map(pieces), "array<string>"))
