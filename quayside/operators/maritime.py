"""Vessel, port and ownership checks against the maritime tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.functions.common import rnd
from quayside.operators.matching import best_containing


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row of each key; one row per key and map task is all that is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def latest_position(batches: DataFrame, ais: DataFrame, as_of: Column | None = None, within_days: int | None = None) -> DataFrame:
    """Latest known position whose vessel name contains the batch's vessel name.

    The position log is reduced to one row per vessel first; each distinct name is looked up once and joined back by equality.
    """
    if as_of is not None:
        ais = ais.where(F.col("ts") <= as_of)
        if within_days is not None:
            ais = ais.where(F.col("ts") > as_of - F.expr(f"INTERVAL {int(within_days)} DAYS"))
    newest = latest_per_key(ais.withColumn("name", F.lower("vessel_name")), ["name"], ["ts", "event_id"])
    named = batches.withColumn("want", F.lower("vessel_name"))
    position = F.struct(F.col("vessel_name").alias("ais_name"), F.col("ts").alias("position_ts"), "eta", "speed")
    best = best_containing(named, newest, F.max_by(position, F.struct("ts", "event_id")))
    return named.join(best, "want", "left").select(*batches.columns, "best.*")


def latest_position_by_id(batches: DataFrame, ais: DataFrame, as_of: Column, within_days: int = 30) -> DataFrame:
    """Latest position by vessel number, else by equal name, within the last days; two equality joins."""
    recent = ais.where((F.col("ts") <= as_of) & (F.col("ts") > as_of - F.expr(f"INTERVAL {int(within_days)} DAYS")))
    newest = latest_per_key(recent, ["imo"], ["ts", "event_id"]).select("imo", F.lower("vessel_name").alias("_name"), "ts", "eta")
    by_name = latest_per_key(newest, ["_name"], ["ts", "imo"]).select("_name", F.struct("ts", "eta").alias("by_name"))
    joined = batches.join(newest.select("imo", F.struct("ts", "eta").alias("by_id")), "imo", "left").join(
        by_name, F.lower(batches["vessel_name"]) == F.col("_name"), "left"
    )
    hit = F.coalesce("by_id", "by_name")
    return joined.select(*[joined[c] for c in batches.columns], hit["ts"].alias("position_ts"), hit["eta"].alias("ais_eta"))


def lineup_upcoming(batches: DataFrame, lineups: DataFrame, as_of: Column) -> DataFrame:
    """Earliest line-up of the vessel at the port that is not more than a week past."""
    first = lineups.where(F.col("eta") > as_of - F.expr("INTERVAL 7 DAYS")).groupBy("imo", "port").agg(F.min("eta").alias("lineup_eta"))
    return batches.join(first, ["imo", "port"], "left")


def lineup_around(batches: DataFrame, lineups: DataFrame, days: int = 7) -> DataFrame:
    """Nearest line-up within ``days`` of the arrival date.

    Line-ups are reduced to distinct days and joined through a time bucket of twice the reach, so
    a document meets at most two buckets of days however many line-ups a vessel has.
    """
    width = 2 * days + 1
    day = F.unix_date(F.to_date("eta"))
    known = lineups.groupBy("imo", "port", day.alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.floor(F.col("day") / width))
    asked = batches.select("imo", "port", F.unix_date("arrival").alias("want")).distinct()
    spots = F.array_distinct(F.array(F.floor((F.col("want") - days) / width), F.floor((F.col("want") + days) / width)))
    near = (
        asked.withColumn("bucket", F.explode(spots)).join(known, ["imo", "port", "bucket"])
        .where(F.abs(F.col("day") - F.col("want")) <= days)
        .groupBy("imo", "port", "want").agg(F.min_by("day", F.struct(F.abs(F.col("day") - F.col("want")), "day")).alias("lineup_day"))
    )
    b = batches.withColumn("want", F.unix_date("arrival"))
    return b.join(near, ["imo", "port", "want"], "left").drop("want").withColumn("lineup_confirmed", F.col("lineup_day").isNotNull())


def vessel_characteristics(batches: DataFrame, vessels: DataFrame) -> DataFrame:
    """Vessel record by number, else by name: two equality joins in place of an OR condition."""
    attrs = F.struct("name", "flag", "built_year", "dead_year", "trading", "vessel_type")
    by_id = vessels.groupBy("imo").agg(F.max(attrs).alias("by_id"))
    by_name = vessels.groupBy(F.lower("name").alias("_name")).agg(F.max(attrs).alias("by_name"))
    joined = batches.join(by_id, "imo", "left").join(by_name, F.lower(batches["vessel_name"]) == F.col("_name"), "left")
    hit = F.coalesce("by_id", "by_name")
    found = joined.select(*[joined[c] for c in batches.columns], hit.alias("v"))
    scrapped = F.coalesce(F.col("v.dead_year") <= F.year("bl_date"), F.lit(False))
    return found.select(
        *batches.columns, F.col("v").isNotNull().alias("vessel_known"), F.col("v.built_year").alias("built_year"), F.col("v.vessel_type").alias("vessel_type"),
        scrapped.alias("scrapped"), F.coalesce(~F.col("v.trading"), F.lit(False)).alias("not_trading"),
    )


def owner_risk(batches: DataFrame, owners: DataFrame) -> DataFrame:
    """Risk score of the owner's country; the highest when a vessel has several owners."""
    top = owners.groupBy("imo").agg(F.max_by("country", F.struct("risk", "country")).alias("owner_country"), F.max("risk").alias("owner_risk"))
    return batches.join(top, "imo", "left")


def on_watch_list(name: Column, names: Sequence[str] = tuple(K.WATCHED_VESSELS)) -> Column:
    return F.coalesce(F.upper(F.trim(name)).isin(list(names)), F.lit(False))


def watch_list_hits(batches: DataFrame, watch_list: DataFrame) -> DataFrame:
    """Batches whose vessel is on a watch list table."""
    listed = watch_list.select(F.upper(F.trim("name")).alias("_listed")).distinct()
    return batches.join(listed, F.upper(F.trim(batches["vessel_name"])) == F.col("_listed"), "left_semi")


def vessel_issues(checked: DataFrame) -> DataFrame:
    """Issue rows of the vessel checks. Input has the results of the joins above as columns."""
    c = F.col

    def issue(test: Column, severity: str, code: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))

    issues = F.array_compact(
        F.array(
            issue(c("scrapped"), "CRITICAL", "V001"),
            issue(c("not_trading"), "WARNING", "V002"),
            issue(F.abs(F.datediff("arrival", F.to_date("ais_eta"))) > 3, "WARNING", "V003"),
            issue(~c("lineup_confirmed"), "INFO", "V004"),
            issue(on_watch_list(c("vessel_name")), "CRITICAL", "V004"),
        )
    )
    return checked.select("batch_id", F.inline(issues))


def vessel_issues_by_name(checked: DataFrame) -> DataFrame:
    """The variant by name only: not seen, arrival before the bill, not in the line-up, on a watch list."""
    c = F.col

    def issue(test: Column, severity: str, code: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))

    missing = F.coalesce("vessel_name", F.lit("")) == ""
    issues = F.when(missing, F.array(F.struct(F.lit("CRITICAL").alias("severity"), F.lit("V001").alias("code")))).otherwise(
        F.array_compact(
            F.array(
                issue(c("ais_name").isNull(), "WARNING", "V001"),
                issue(c("eta") < c("bl_date").cast("timestamp") - F.expr("INTERVAL 72 HOURS"), "WARNING", "V003"),
                issue(c("lineup_eta").isNull(), "INFO", "V003"),
                issue(on_watch_list(c("vessel_name")), "CRITICAL", "V004"),
            )
        )
    )
    return checked.select("batch_id", F.inline(issues))


def _message(name: str) -> Column:
    """Text of an issue with its columns filled in; a missing value is empty."""
    parts = re.split(r"\{(\w+)\}", K.VESSEL_MESSAGES[name])
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def vessel_report(checked: DataFrame) -> DataFrame:
    """One row per batch of the variant by name: status, whether to go on, the issues with their texts, and what was confirmed.

    A batch without a vessel name is critical and nothing else is looked at."""
    named = F.coalesce("vessel_name", F.lit("")) != ""
    rows = checked.withColumn("eta_day", F.date_format("eta", "yyyy-MM-dd"))

    def issue(test: Column, severity: str, code: str, text: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), _message(text).alias("message")))

    seen = F.col("ais_name").isNotNull()
    found = F.array_compact(
        F.array(
            issue(~named, "CRITICAL", "V001", "no_name"), issue(named & ~seen, "WARNING", "V001", "not_seen"),
            issue(named & seen & (F.col("eta") < F.col("bl_date").cast("timestamp") - F.expr("INTERVAL 72 HOURS")), "WARNING", "V003", "eta"),
            issue(named & F.col("lineup_eta").isNull(), "INFO", "V003", "no_lineup"), issue(named & on_watch_list(F.col("vessel_name")), "CRITICAL", "V004", "watched"),
        )
    )
    worst = lambda severity: F.exists("issues", lambda i: i["severity"] == severity)
    status = F.when(worst("CRITICAL"), "critical").when(worst("WARNING"), "warning").when(F.size("issues") > 0, "info").otherwise("passed")
    rows = rows.withColumn("issues", found).withColumn("status", status)
    return rows.select(
        "batch_id", "status", (F.col("status") != "critical").alias("passed"), "issues", (named & seen).alias("vessel_confirmed"),
        F.when(named & seen, F.col("eta")).alias("ais_eta"), (named & F.col("lineup_eta").isNotNull()).alias("lineup_confirmed"),
    )


def vessel_status(batches: DataFrame, issues: DataFrame) -> DataFrame:
    """Worst severity per batch: critical, warning, info, or passed without issues."""
    rank = F.when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "WARNING", 2).otherwise(1)
    worst = issues.groupBy("batch_id").agg(F.max(rank).alias("worst"), F.count(F.lit(1)).alias("issues"))
    label = F.element_at(F.array(*[F.lit(x) for x in ("passed", "info", "warning", "critical")]), F.coalesce("worst", F.lit(0)) + 1)
    return batches.select("batch_id").join(worst, "batch_id", "left").select(
        "batch_id", label.alias("status"), F.coalesce("issues", F.lit(0)).alias("issues"), (F.coalesce("worst", F.lit(0)) < 3).alias("passed")
    )


def port_congestion(lineups: DataFrame) -> DataFrame:
    """Line-ups per port and day, scaled to the busiest port and day."""
    per_day = lineups.groupBy("port", F.to_date("eta").alias("day")).agg(F.count(F.lit(1)).alias("ships"))
    peak = per_day.agg(F.max("ships").alias("peak"))
    return per_day.select("port", F.date_format("day", "yyyy-MM-dd").alias("day"), "ships", rnd(F.col("ships") / peak.scalar(), 6).alias("congestion"))


def maritime_features(checked: DataFrame) -> DataFrame:
    """Numeric vessel signals per batch."""
    return checked.select(
        "batch_id",
        F.coalesce(F.abs(F.datediff("arrival", F.to_date("ais_eta"))), F.lit(0)).alias("eta_delta_days"),
        F.col("ais_eta").isNotNull().alias("in_ais"), "lineup_confirmed",
        (F.year("arrival") - F.coalesce("built_year", F.year("arrival"))).alias("vessel_age"),
        F.coalesce(F.col("vessel_type") == "Container", F.lit(False)).alias("type_matches"),
        F.coalesce("owner_risk", F.lit(0.0)).alias("owner_risk"), F.datediff("arrival", "bl_date").alias("transit_days"),
    )


# --- ports and carriers -----------------------------------------------------------------------------------

def resolve_port(c: Column, table: Sequence[tuple[str, str]] = tuple(K.PORT_NAMES)) -> Column:
    """Location code of a printed port name: equal, else contained either way, first table entry wins."""
    name = F.upper(F.trim(c))
    exact = F.try_element_at(F.create_map(*[F.lit(x) for pair in table for x in pair]), name)
    partial = [F.when((name != "") & (F.contains(name, F.lit(k)) | F.contains(F.lit(k), name)), F.lit(code)) for k, code in table]
    return F.coalesce(exact, *partial)


def detect_carrier(text: Column, bl_number: Column) -> Column:
    """Carrier code: printed code, else prefix of the bill number, else the carrier's name in the text."""
    codes = "|".join(K.CARRIERS)
    printed = F.nullif(F.regexp_extract(F.upper(text), rf"\bSCAC(?:\s+CODE)?\s*:?\s*({codes})\b", 1), F.lit(""))
    by_prefix = [F.when(F.upper(bl_number).rlike("^(" + "|".join(p["bl_prefixes"]) + ")"), F.lit(code)) for code, p in K.CARRIERS.items()]
    by_name = [F.when(F.contains(F.upper(text), F.lit(p["name"].upper())), F.lit(code)) for code, p in K.CARRIERS.items()]
    return F.coalesce(printed, *by_prefix, *by_name)
