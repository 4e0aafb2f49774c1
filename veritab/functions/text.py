"""Hash keys and the extraction of recommendations from response texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.numeric import clamp
from veritab.schema import col


def text_hash(text: Column) -> Column:
    """SHA-256 of a text, as 64 hexadecimal digits."""
    return F.sha2(text, 256)


RESPONSE_SCHEMA = (
    "recommended_models array<struct<model: string, confidence: string, reasoning: string>>, "
    "recommended_preprocessing array<struct<step: string, reasoning: string>>, "
    "analysis_type string, reasoning string"
)
DEFAULT_CONFIDENCE = 0.5


def parse_responses(df: DataFrame, text_column: str) -> DataFrame:
    """Add the fields of the JSON object found between the first ``{`` and the last ``}`` of a text.

    Missing fields take their defaults and confidences are brought to [0, 1].
    A text without a readable object keeps its words as ``reasoning`` and is
    marked ``raw``.
    """
    text = col(text_column)
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = df.withColumn("_json", block).withColumn(
        "_readable", F.coalesce((block != "") & F.try_parse_json(F.concat(F.lit("["), block, F.lit("]"))).isNotNull(), F.lit(False))
    ).withColumn("_r", F.from_json("_json", RESPONSE_SCHEMA))
    stated = F.col("_r.recommended_models")
    number_ok = ~F.coalesce(
        F.exists(stated, lambda m: m["confidence"].isNotNull() & m["confidence"].try_cast("double").isNull()),
        F.lit(False))
    ok = F.col("_readable") & number_ok
    no_models = F.array().cast("array<struct<model: string, confidence: double, reasoning: string>>")
    no_steps = F.array().cast("array<struct<step: string, reasoning: string>>")
    models = F.transform(stated, lambda m: F.struct(
        m["model"].alias("model"),
        clamp(F.coalesce(m["confidence"].try_cast("double"), F.lit(DEFAULT_CONFIDENCE)), 0.0, 1.0).alias("confidence"),
        m["reasoning"].alias("reasoning"),
    ))
    return parsed.select(
        *[col(c) for c in df.columns],
        F.when(ok, F.coalesce(models, no_models)).otherwise(no_models).alias("recommended_models"),
        F.when(ok, F.coalesce("_r.recommended_preprocessing", no_steps)).otherwise(no_steps)
        .alias("recommended_preprocessing"),
        F.when(ok, F.coalesce("_r.analysis_type", F.lit("exploratory"))).otherwise("exploratory")
        .alias("analysis_type"),
        F.when(ok, F.coalesce("_r.reasoning", F.lit(""))).otherwise(text).alias("reasoning"),
        F.when(ok, "structured").otherwise("raw").alias("source"),
    )
