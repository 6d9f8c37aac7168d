"""Engine outputs in three JSON shapes, read into observation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELD_SHAPE = "fields map<string, struct<value: string, confidence: double>>"
CELL_SHAPE = "table_cells array<struct<key: string, value: string, confidence: double>>"
TEXT_SHAPE = "text_blocks array<string>, confidence double"
# Confidences of shapes that carry none
CELL_CONFIDENCE = 0.75
TEXT_CONFIDENCE = 0.7


def payload_observations(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per field an engine reported; which shape a payload has is told by its keys."""
    parsed = df.select(*keys, F.from_json("payload", f"{FIELD_SHAPE}, {TEXT_SHAPE}, {CELL_SHAPE}").alias("p"))
    cell = "struct<field: string, value: string, confidence: double>"
    none = F.array().cast(f"array<{cell}>")

    from_fields = F.transform(
        F.map_entries("p.fields"),
        lambda e: F.struct(e["key"].alias("field"), e["value"]["value"].alias("value"), F.coalesce(e["value"]["confidence"], F.lit(0.0)).alias("confidence")),
    )
    labelled = F.filter("p.text_blocks", lambda t: F.contains(F.upper(t), F.lit("B/L")) | F.contains(F.upper(t), F.lit("BL NO")))
    from_text = F.transform(
        F.filter(labelled, lambda t: t.rlike(r"[:\s]")),
        lambda t: F.struct(
            F.lit("bl_number").alias("field"), F.trim(F.regexp_replace(t, r"^[^:\s]*[:\s]+", "")).alias("value"),
            F.coalesce(F.col("p.confidence"), F.lit(TEXT_CONFIDENCE)).alias("confidence"),
        ),
    )
    # a later line overwrites an earlier one
    last_text = F.slice(from_text, F.greatest(F.size(from_text), F.lit(1)), 1)
    from_cells = F.transform(
        F.filter("p.table_cells", lambda c: (c["key"] != "") & (c["value"] != "")),
        lambda c: F.struct(
            F.regexp_replace(F.lower(c["key"]), " ", "_").alias("field"), c["value"].alias("value"),
            F.coalesce(c["confidence"], F.lit(CELL_CONFIDENCE)).alias("confidence"),
        ),
    )
    rows = F.when(F.col("p.fields").isNotNull(), from_fields).when(F.col("p.text_blocks").isNotNull(), last_text).otherwise(from_cells)
    return parsed.select(*keys, F.inline(F.coalesce(rows.cast(f"array<{cell}>"), none)))
