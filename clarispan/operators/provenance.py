"""Coverage answers of single sources: construction, rendering, the need to confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarispan import policy
from clarispan.functions.scalars import answer_confidence


def make_answers(claims: DataFrame) -> DataFrame:
    """Adds `confidence` to claims (source, value, fetched_at, source_last_updated); an explicit
    `confidence` column, where it is not null, overrides."""
    made = answer_confidence(F.col("source"), F.col("value"), F.col("fetched_at"), F.col("source_last_updated"))
    if "confidence" in claims.columns:
        made = F.coalesce(F.col("confidence"), made)
    return claims.withColumn("confidence", made)


def needs_confirmation(value: Column, confidence: Column, conflicts: Column) -> Column:
    return (value == "unknown") | conflicts | (confidence < policy.CONFIRM_BELOW)


def render(answers: DataFrame) -> DataFrame:
    """Adds `rendered`, an answer as one sentence (columns as of make_answers, and subject_key)."""
    fresh = F.coalesce(F.concat(F.lit(", source updated "), F.date_format("source_last_updated", "yyyy-MM-dd")), F.lit(""))
    share = F.concat(F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("% confidence"))
    confirm = F.when(needs_confirmation(F.col("value"), F.col("confidence"), F.lit(False)), " - confirm before enrolling.").otherwise("")
    said = F.when(F.col("value") == "yes", "shown in-network").otherwise("shown NOT covered")
    unknown = F.concat(F.col("subject_key"), F.lit(": coverage unknown; no verified answer available from "), "source", fresh, F.lit(" ("), share, F.lit(")."), confirm)
    known = F.concat(F.col("subject_key"), F.lit(": "), said, F.lit(" per "), "source", fresh, F.lit(" ("), share, F.lit(")."), confirm)
    return answers.withColumn("rendered", F.when(F.col("value") == "unknown", unknown).otherwise(known))
