"""Small dimension tables: rules, carriers, field lists, ground truth.

All of them come from configuration that a person maintains (tens of rows), so they may be
broadcast; they are read anew for every job or micro-batch, which replaces a reload signal.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside import constants as K

RESOURCES = Path(__file__).resolve().parent.parent / "resources"
RULE_SCHEMA = """id string, name string, type string, fields array<string>, regex string, tolerance_pct double,
    severity string, scope array<string>, check string, error_message string"""


def rule_list(name_or_path: str = "rules_file") -> list[dict]:
    """Rules of a set as plain records, from a packaged set or a JSON file."""
    path = Path(name_or_path)
    path = path if path.suffix == ".json" else RESOURCES / f"{name_or_path}.json"
    return json.loads(path.read_text(encoding="utf-8"))["rules"]


def load_rules(spark: SparkSession, name_or_path: str = "rules_file") -> DataFrame:
    """Rules as a dimension, one row per rule."""
    rows = [[r.get(c) for c in ("id", "name", "type", "fields", "regex", "tolerance_pct", "severity", "scope", "check", "error_message")] for r in rule_list(name_or_path)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The same dimension from a JSON document on shared storage."""
    return spark.read.option("multiLine", True).schema(f"rules array<struct<{_as_struct(RULE_SCHEMA)}>>").json(path).select(F.inline("rules"))


def _as_struct(ddl: str) -> str:
    return ", ".join(f"`{p.split()[0]}`: {' '.join(p.split()[1:])}" for p in ddl.replace("\n", " ").split(", "))


def rule_fields(rules: DataFrame) -> DataFrame:
    """One row per rule and field it looks at, with the field's place in the rule."""
    return rules.select("id", "name", "type", "regex", "tolerance_pct", "severity", "scope", "fields", F.posexplode("fields").alias("place", "field"))


def load_fallback_risk(path: str | None = None) -> dict:
    return json.loads((Path(path) if path else RESOURCES / "fallback_risk.json").read_text(encoding="utf-8"))


def carriers(spark: SparkSession) -> DataFrame:
    """Carrier profiles, one row per carrier; a null-safe explode of the vessels is left to the caller."""
    rows = [
        (code, c["name"], c["route"], c["bl_pattern"], c["bl_prefixes"], c["strip_prefixes"], c["strip_suffixes"], c["vessels"])
        for code, c in K.CARRIERS.items()
    ]
    return spark.createDataFrame(
        rows,
        "scac string, name string, route string, bl_pattern string, bl_prefixes array<string>, strip_prefixes array<string>, strip_suffixes array<string>, vessels array<string>",
    )


TRUTH_SCHEMA = "map<string, struct<carrier: string, pages: int, insw_flag: boolean, fields: map<string, string>>>"


def ground_truth(annotations: DataFrame, column: str, alternatives: dict[str, list[str]]) -> DataFrame:
    """Annotation map (document key -> annotation) to one row per document and field with its accepted values."""
    doc = annotations.select(F.explode(F.from_json(column, TRUTH_SCHEMA)).alias("doc_key", "a"))
    cells = F.array(
        *[
            F.struct(
                F.lit(field).alias("field"),
                F.filter(
                    F.array(*[F.try_element_at("a.fields", F.lit(name)) for name in names]), lambda v: v.isNotNull() & (F.trim(v) != "")
                ).alias("accepted"),
            )
            for field, names in alternatives.items()
        ]
    )
    return doc.select("doc_key", F.col("a.carrier").alias("carrier"), F.col("a.insw_flag").alias("restricted"), F.inline(cells))
