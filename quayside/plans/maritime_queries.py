"""Vessel, port, carrier and tariff queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.functions import normalize as N
from quayside.functions import validate as V
from quayside.operators import maritime as M
from quayside.operators import tariff as T
from quayside.plans import bindings as B
from quayside.plans.bindings import oracle
from quayside.plans.catalog import query
from quayside.plans.scalar_queries import lines, pick
from quayside.sources import dims
from quayside.sources.tables import read_table

AS_OF = "2024-01-28 00:00:00"

VOYAGES = """SELECT o_orderkey AS batch_id, o_custkey % 250 AS imo, 'Vessel ' || (o_custkey % 250)::VARCHAR AS vessel_name,
    DATE '2024-01-05' + (o_orderkey % 30)::INT AS bl_date, DATE '2024-01-05' + (o_orderkey % 30)::INT + (o_orderkey % 7)::INT AS arrival,
    'NATION_' || (o_orderkey % 25)::VARCHAR AS port FROM orders"""


def voyages(spark, base) -> DataFrame:
    o = read_table(spark, base, "orders", ["o_orderkey", "o_custkey"])
    key = F.pmod("o_custkey", F.lit(250))
    bl = F.date_add(F.lit("2024-01-05").cast("date"), F.pmod("o_orderkey", F.lit(30)).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("batch_id"), key.alias("imo"), F.concat(F.lit("Vessel "), key.cast("string")).alias("vessel_name"), bl.alias("bl_date"),
        F.date_add(bl, F.pmod("o_orderkey", F.lit(7)).cast("int")).alias("arrival"),
        F.concat(F.lit("NATION_"), F.pmod("o_orderkey", F.lit(25)).cast("string")).alias("port"),
    )


def ship_lineups(spark, base) -> DataFrame:
    """Line-ups moved into the voyage months: the ship date's day of the year, from January 2024 on."""
    day = F.pmod(F.dayofyear("eta"), F.lit(45)).cast("int")
    return B.lineups(spark, base).select("imo", "port", F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("eta"))


LINEUPS = "SELECT imo, port, (DATE '2024-01-01' + (dayofyear(eta) % 45)::INT)::TIMESTAMP AS eta FROM lineups"
NEWEST = "SELECT lower(vessel_name) AS name, arg_max(vessel_name, (ts, event_id)) AS ais_name, max(ts) AS ts, arg_max(eta, (ts, event_id)) AS eta, arg_max(event_id, (ts, event_id)) AS event_id FROM positions GROUP BY 1"


@query("latest_per_key", oracle("SELECT imo, event_id, speed FROM (SELECT *, row_number() OVER (PARTITION BY imo ORDER BY ts DESC, event_id DESC) AS n FROM positions) WHERE n = 1", "positions"))
def _latest(spark, base):
    return M.latest_per_key(B.positions(spark, base).select("imo", "ts", "event_id", "speed"), ["imo"], ["ts", "event_id"]).select("imo", "event_id", "speed")


_LATEST = """SELECT want, arg_max(ais_name, (ts, event_id)) AS ais_name, arg_max(eta, (ts, event_id)) AS eta, max(ts) AS ts FROM (SELECT DISTINCT lower(vessel_name) AS want FROM voy) JOIN newest ON contains(name, want) GROUP BY 1"""


@query("latest_position", oracle("SELECT batch_id, vessel_name, ais_name, epoch_us(ts)::DOUBLE AS position_us FROM voy LEFT JOIN best ON lower(vessel_name) = want", "positions", voy=VOYAGES, newest=NEWEST, best=_LATEST))
def _position(spark, base):
    out = M.latest_position(voyages(spark, base), B.positions(spark, base))
    return out.select("batch_id", "vessel_name", "ais_name", F.unix_micros("position_ts").cast("double").alias("position_us"))


_RECENT = f"SELECT imo, max(ts) AS ts, arg_max(eta, (ts, event_id)) AS eta FROM positions WHERE ts <= TIMESTAMP '{AS_OF}' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY GROUP BY 1"


@query("latest_position_by_id", oracle("SELECT batch_id, epoch_us(ts)::DOUBLE AS position_us, epoch_us(eta)::DOUBLE AS eta_us FROM voy LEFT JOIN recent ON voy.imo = recent.imo", "positions", voy=VOYAGES, recent=_RECENT))
def _position_id(spark, base):
    out = M.latest_position_by_id(voyages(spark, base), B.positions(spark, base), F.to_timestamp(F.lit(AS_OF)), 20)
    return out.select("batch_id", F.unix_micros("position_ts").cast("double").alias("position_us"), F.unix_micros("ais_eta").cast("double").alias("eta_us"))


@query("lineup_match", oracle(f"""SELECT batch_id, strftime(min(l.eta), '%Y-%m-%d') AS lineup_day FROM voy LEFT JOIN sl l ON voy.imo = l.imo AND voy.port = l.port AND l.eta > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1""", "lineups", voy=VOYAGES, sl=LINEUPS))
def _lineup(spark, base):
    out = M.lineup_upcoming(voyages(spark, base), ship_lineups(spark, base), F.to_timestamp(F.lit(AS_OF)))
    return out.select("batch_id", F.date_format("lineup_eta", "yyyy-MM-dd").alias("lineup_day"))


_AROUND = """SELECT batch_id, arg_min(d, (abs(d - arrival), d)) AS lineup_day FROM (SELECT DISTINCT imo, port, eta::DATE AS d FROM sl) l JOIN voy USING (imo, port) WHERE abs(d - arrival) <= 7 GROUP BY 1"""


@query("lineup_around", oracle("SELECT batch_id, lineup_day IS NOT NULL AS lineup_confirmed, strftime(lineup_day, '%Y-%m-%d') AS lineup_day FROM voy LEFT JOIN near USING (batch_id)", "lineups", voy=VOYAGES, sl=LINEUPS, near=_AROUND))
def _around(spark, base):
    out = M.lineup_around(voyages(spark, base), ship_lineups(spark, base))
    return out.select("batch_id", "lineup_confirmed", F.date_format(F.date_from_unix_date(F.col("lineup_day").cast("int")), "yyyy-MM-dd").alias("lineup_day"))


_CHAR = """SELECT voy.*, v.imo IS NOT NULL AS vessel_known, v.built_year, v.vessel_type, coalesce(v.dead_year <= year(bl_date), false) AS scrapped, coalesce(NOT v.trading, false) AS not_trading FROM voy LEFT JOIN vessels v ON voy.imo = v.imo"""


@query("vessel_characteristics", oracle("SELECT batch_id, vessel_known, scrapped, not_trading, vessel_type FROM ch", "vessels", voy=VOYAGES, ch=_CHAR))
def _characteristics(spark, base):
    return M.vessel_characteristics(voyages(spark, base), B.vessels(spark, base)).select("batch_id", "vessel_known", "scrapped", "not_trading", "vessel_type")


@query("owner_risk", oracle("SELECT batch_id, country AS owner_country, risk AS owner_risk FROM voy LEFT JOIN owners USING (imo)", "owners", voy=VOYAGES))
def _owner(spark, base):
    return M.owner_risk(voyages(spark, base), B.owners(spark, base)).select("batch_id", "owner_country", "owner_risk")


@query("sanctions_screen", oracle("SELECT batch_id, vessel_name FROM voy WHERE upper(vessel_name) IN (SELECT 'VESSEL ' || s_suppkey::VARCHAR FROM supplier WHERE s_acctbal < 0)", voy=VOYAGES))
def _sanctions(spark, base):
    s = read_table(spark, base, "supplier", ["s_suppkey", "s_acctbal"], "s_acctbal < 0")
    watch = s.select(F.concat(F.lit("vessel "), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("name"))
    return M.watch_list_hits(voyages(spark, base), watch).select("batch_id", "vessel_name")


def checked(spark, base) -> DataFrame:
    v = voyages(spark, base)
    known = M.vessel_characteristics(v, B.vessels(spark, base))
    placed = M.latest_position_by_id(known, B.positions(spark, base), F.to_timestamp(F.lit(AS_OF)), 20)
    return M.lineup_around(M.owner_risk(placed, B.owners(spark, base)), ship_lineups(spark, base))


_CHECKED = {
    "voy": VOYAGES, "sl": LINEUPS, "near": _AROUND, "ch": _CHAR, "recent": _RECENT,
    "allchecks": "SELECT ch.*, recent.eta AS ais_eta, n.lineup_day IS NOT NULL AS lineup_confirmed, owners.risk AS owner_risk FROM ch LEFT JOIN recent ON ch.imo = recent.imo LEFT JOIN near n USING (batch_id) LEFT JOIN owners ON ch.imo = owners.imo",
    "issues": """SELECT batch_id, 'CRITICAL' AS severity, 'V001' AS code FROM allchecks WHERE scrapped UNION ALL SELECT batch_id, 'WARNING', 'V002' FROM allchecks WHERE not_trading
        UNION ALL SELECT batch_id, 'WARNING', 'V003' FROM allchecks WHERE abs(arrival - ais_eta::DATE) > 3 UNION ALL SELECT batch_id, 'INFO', 'V004' FROM allchecks WHERE NOT lineup_confirmed""",
}
_NEEDS = ("lineups", "vessels", "positions", "owners")


@query("vessel_issues", oracle("SELECT * FROM issues", *_NEEDS, **_CHECKED))
def _issues(spark, base):
    return M.vessel_issues(checked(spark, base))


@query("vessel_status", oracle("""SELECT batch_id, CASE coalesce(max(CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 WHEN 'INFO' THEN 1 END), 0) WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' WHEN 1 THEN 'info' ELSE 'passed' END AS status,
    count(severity) AS issues, count(*) FILTER (severity = 'CRITICAL') = 0 AS passed FROM voy LEFT JOIN issues USING (batch_id) GROUP BY 1""", *_NEEDS, **_CHECKED))
def _status(spark, base):
    return M.vessel_status(voyages(spark, base), M.vessel_issues(checked(spark, base)))


@query("vessel_issues_by_name", oracle(f"""SELECT batch_id, 'WARNING' AS severity, 'V001' AS code FROM x WHERE ais_name IS NULL UNION ALL SELECT batch_id, 'WARNING', 'V003' FROM x WHERE eta < bl_date::TIMESTAMP - INTERVAL 72 HOUR
    UNION ALL SELECT batch_id, 'INFO', 'V003' FROM x WHERE lineup_eta IS NULL""", "positions", "lineups", voy=VOYAGES, newest=NEWEST, best=_LATEST, sl=LINEUPS,
    up=f"SELECT imo, port, min(eta) AS lineup_eta FROM sl WHERE eta > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1, 2",
    x="SELECT voy.*, best.ais_name, best.eta, up.lineup_eta FROM voy LEFT JOIN best ON lower(vessel_name) = want LEFT JOIN up USING (imo, port)"))
def _issues_name(spark, base):
    placed = M.latest_position(voyages(spark, base), B.positions(spark, base))
    return M.vessel_issues_by_name(M.lineup_upcoming(placed, ship_lineups(spark, base), F.to_timestamp(F.lit(AS_OF))))


_BY_NAME = {
    "voy": VOYAGES, "newest": NEWEST, "best": _LATEST, "sl": LINEUPS, "up": f"SELECT imo, port, min(eta) AS lineup_eta FROM sl WHERE eta > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1, 2",
    "x": "SELECT voy.*, best.ais_name, best.eta, up.lineup_eta FROM voy LEFT JOIN best ON lower(vessel_name) = want LEFT JOIN up USING (imo, port)",
}


@query("vessel_report", oracle("""SELECT batch_id, CASE WHEN ais_name IS NULL OR late THEN 'warning' WHEN lineup_eta IS NULL THEN 'info' ELSE 'passed' END AS status, true AS passed, ais_name IS NOT NULL AS vessel_confirmed, lineup_eta IS NOT NULL AS lineup_confirmed,
    epoch_us(eta)::DOUBLE AS eta_us, concat_ws('|', CASE WHEN ais_name IS NULL THEN 'V001 Vessel ' || vessel || ' not found in AIS database. Manual verification recommended.' END,
    CASE WHEN late THEN 'V003 ETA discrepancy: AIS reports vessel arrival ' || strftime(eta, '%Y-%m-%d') || ' but B/L date is ' || strftime(bl_date, '%Y-%m-%d') || '. Difference exceeds 72 hours.' END,
    CASE WHEN lineup_eta IS NULL THEN 'V003 Vessel ' || vessel || ' not found in port lineup for ' || chr(39) || port || chr(39) || '. This is informational only.' END) AS issues
    FROM (SELECT *, chr(39) || vessel_name || chr(39) AS vessel, coalesce(eta < bl_date::TIMESTAMP - INTERVAL 72 HOUR, false) AS late FROM x)""", "positions", "lineups", **_BY_NAME))
def _report(spark, base):
    placed = M.latest_position(voyages(spark, base), B.positions(spark, base))
    out = M.vessel_report(M.lineup_upcoming(placed, ship_lineups(spark, base), F.to_timestamp(F.lit(AS_OF))))
    texts = F.array_join(F.transform("issues", lambda i: F.concat(i["code"], F.lit(" "), i["message"])), "|")
    return out.select("batch_id", "status", "passed", "vessel_confirmed", "lineup_confirmed", F.unix_micros("ais_eta").cast("double").alias("eta_us"), texts.alias("issues"))


@query("port_congestion", oracle("SELECT port, strftime(d, '%Y-%m-%d') AS day, ships, round((ships / max(ships) OVER ()::DOUBLE)::DECIMAL(18,8), 6)::DOUBLE AS congestion FROM (SELECT port, eta::DATE AS d, count(*) AS ships FROM lineups GROUP BY 1, 2)", "lineups"))
def _congestion(spark, base):
    return M.port_congestion(B.lineups(spark, base))


@query("maritime_features", oracle("""SELECT batch_id, coalesce(abs(arrival - ais_eta::DATE), 0) AS eta_delta_days, ais_eta IS NOT NULL AS in_ais, lineup_confirmed, year(arrival) - coalesce(built_year, year(arrival)) AS vessel_age,
    coalesce(vessel_type = 'Container', false) AS type_matches, coalesce(owner_risk, 0.0) AS owner_risk, arrival - bl_date AS transit_days FROM allchecks""", *_NEEDS, **_CHECKED))
def _features(spark, base):
    return M.maritime_features(checked(spark, base))


_PORTS = "CASE l_partkey % 27 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(K.PORT_NAMES)) + " WHEN 24 THEN 'DEHAM' WHEN 25 THEN 'IDJBK' END"


@query("resolve_port", oracle(f"SELECT doc_id, {_PORTS} AS port FROM docs", "docs"))
def _port(spark, base):
    names = [F.lit(f" {n.lower()} ") for n, _ in K.PORT_NAMES] + [F.lit("Port of Hamburg, Germany"), F.lit("cikarang dry"), F.lit("Atlantis")]
    return lines(spark, base).select("doc_id", M.resolve_port(pick(F.pmod("pk", F.lit(27)), *names)).alias("port"))


_SCAC = "CASE l_partkey % 6 WHEN 0 THEN 'HLCU' WHEN 1 THEN 'MAEU' WHEN 2 THEN 'EGLV' WHEN 3 THEN 'CSLU' WHEN 4 THEN 'CMDU' END"


def carrier_docs(spark, base) -> DataFrame:
    k, number = F.pmod("l_partkey", F.lit(6)), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")
    text = pick(k, F.lit("SCAC Code: HLCU bill"), F.lit("carrier SCAC MAEU"), F.lit("bill"), F.lit("bill"), F.lit("shipped by cma cgm line"), F.lit("unknown line"))
    bl = F.concat(pick(k, F.lit("HLCU"), F.lit(""), F.lit("EISU"), F.lit("CSX"), F.lit("77"), F.lit("99")), number)
    return lines(spark, base).select("doc_id", "batch_id", "l_suppkey", text.alias("text"), bl.alias("bl_number")).withColumn("scac", M.detect_carrier(F.col("text"), F.col("bl_number")))


@query("detect_carrier", oracle(f"SELECT doc_id, {_SCAC} AS scac FROM docs", "docs"))
def _carrier(spark, base):
    return carrier_docs(spark, base).select("doc_id", "scac")


@query("valid_bl_number", oracle("SELECT doc_id, l_partkey % 6 IN (0, 1, 2) AS ok FROM docs WHERE l_partkey % 6 < 5", "docs"))
def _bl(spark, base):
    d = carrier_docs(spark, base).join(F.broadcast(dims.carriers(spark).select("scac", "bl_pattern")), "scac")
    return d.select("doc_id", V.matches_pattern(F.col("bl_number"), F.col("bl_pattern")).alias("ok"))


@query("carrier_dim", oracle("""SELECT scac, name, vessel, count(*) AS documents FROM (SELECT CASE l_partkey % 6 WHEN 0 THEN 'HLCU' WHEN 1 THEN 'MAEU' WHEN 2 THEN 'EGLV' WHEN 3 THEN 'CSLU' ELSE 'CMDU' END AS scac FROM docs WHERE l_partkey % 6 < 5)
    JOIN (SELECT unnest(['HLCU','HLCU','MAEU','EGLV','EGLV','EGLV','CSLU','CMDU']) AS scac, unnest(['Hapag-Lloyd','Hapag-Lloyd','Maersk','Evergreen','Evergreen','Evergreen','Cordelia','CMA CGM']) AS name,
      unnest(['RIO DE LA PLATA','CAP VERDE','NMV MAERSK COPENHAGEN','CAPE NORVIEGA','HANJIN ROTTERDAM','KMTC DUBAI','GFS GISELLE',NULL]) AS vessel) USING (scac) GROUP BY 1, 2, 3""", "docs"))
def _carrier_dim(spark, base):
    dim = dims.carriers(spark).select("scac", "name", F.explode_outer("vessels").alias("vessel"))
    counted = carrier_docs(spark, base).where("scac is not null").groupBy("scac").agg(F.count(F.lit(1)).alias("documents"))
    return counted.join(F.broadcast(dim), "scac").select("scac", "name", "vessel", "documents")


@query("normalize_vessel_carrier", oracle("SELECT doc_id, CASE l_partkey % 6 WHEN 0 THEN 'CAP ' || l_suppkey::VARCHAR || ' V.' WHEN 1 THEN 'M/V CAP ' || l_suppkey::VARCHAR || ' V.' WHEN 2 THEN 'M/V CAP ' || l_suppkey::VARCHAR ELSE 'M/V CAP ' || l_suppkey::VARCHAR || ' V.' END AS vessel FROM docs WHERE l_partkey % 6 < 5", "docs"))
def _vessel_carrier(spark, base):
    d = carrier_docs(spark, base).join(F.broadcast(dims.carriers(spark)), "scac")
    raw = F.concat(F.lit(" M/V Cap "), F.col("l_suppkey").cast("string"), F.lit(" V."))
    return d.select("doc_id", N.normalize_vessel_for_carrier(raw, F.col("strip_prefixes"), F.col("strip_suffixes")).alias("vessel"))


# --- tariff ---------------------------------------------------------------------------------------------------

_RESTRICTED = "(" + ",".join(f"'{c}'" for c in K.RESTRICTED_CHAPTERS) + ")"


@query("tariff_lookup", oracle("""SELECT i.batch_id, i.doc_id, i.hs_code, t.duty, t.vat, CASE WHEN t.active IS NULL THEN 'unknown' WHEN t.active THEN 'active' ELSE 'inactive' END AS tariff_status
    FROM (SELECT batch_id, doc_id, CASE WHEN line % 5 = 0 THEN '99999999' ELSE hs_code END AS hs_code FROM items) i LEFT JOIN (SELECT hs_code, max(duty) AS duty, max(vat) AS vat, bool_or(active) AS active FROM tariff GROUP BY 1) t ON i.hs_code = t.hs_code""", "items", "tariff"))
def _lookup(spark, base):
    code = F.when(F.pmod("line", F.lit(5)) == 0, "99999999").otherwise(F.col("hs_code"))
    items = B.tariff_items(spark, base).select("batch_id", "doc_id", code.alias("hs_code"))
    return T.tariff_lookup(items, B.tariff(spark, base))


@query("restricted_goods", oracle(f"""SELECT batch_id, count(DISTINCT CASE WHEN left(goods_code, 2) IN {_RESTRICTED} THEN goods_code END) AS restricted_codes, count(*) FILTER (left(goods_code, 2) IN {_RESTRICTED}) = 0 AS passed FROM items GROUP BY 1""", "items"))
def _restricted(spark, base):
    return T.restriction_status(B.tariff_items(spark, base), "goods_code")


_PERMITS = "CASE left(goods_code, 2) " + " ".join(f"WHEN '{c}' THEN '{', '.join(p)}'" for c, p in K.RESTRICTED_CHAPTERS.items()) + " END"


@query("restriction_issues", oracle(f"SELECT doc_id, 'HS ' || goods_code || ' may require: ' || {_PERMITS} AS issue FROM items WHERE left(goods_code, 2) IN {_RESTRICTED}", "items"))
def _restriction_issues(spark, base):
    return T.restriction_issues(B.tariff_items(spark, base), "goods_code").select("doc_id", "issue")


@query("missing_permit", oracle(f"""SELECT DISTINCT batch_id, goods_code AS hs_code, 'CRITICAL' AS severity FROM items i WHERE left(goods_code, 2) IN {_RESTRICTED}
    AND NOT EXISTS (SELECT 1 FROM items p WHERE p.has_permit AND p.batch_id = i.batch_id AND p.goods_code = i.goods_code)""", "items"))
def _permit(spark, base):
    items = B.tariff_items(spark, base)
    permits = items.where("has_permit").select("batch_id", F.col("goods_code").alias("hs_code"))
    return T.missing_permits(items, permits, "goods_code")


@query("company_dictionary", oracle("""SELECT i.doc_id, coalesce(d.own_code, i.hs_code) AS final_code, d.own_code IS NOT NULL AS from_dictionary FROM (SELECT *, b1.company_id FROM items JOIN b1 USING (batch_id)) i
    LEFT JOIN (SELECT company_id, part, max('OWN' || lpad(part::VARCHAR, 5, '0')) AS own_code FROM items JOIN b1 USING (batch_id) WHERE quantity > 45 GROUP BY 1, 2) d ON i.company_id = d.company_id AND i.part = d.part""", "items", "b1"))
def _dictionary(spark, base):
    items = B.tariff_items(spark, base).join(B.batches(spark, base).select("batch_id", "company_id"), "batch_id")
    dictionary = items.where("quantity > 45").select("company_id", "part", F.concat(F.lit("OWN"), F.lpad(F.col("part").cast("string"), 5, "0")).alias("own_code"))
    return T.company_dictionary(items, dictionary, ["company_id", "part"]).select("doc_id", "final_code", "from_dictionary")


@query("index_upsert", oracle("""SELECT hs_code, max(hs_code || ' ' || description || CASE WHEN NOT active THEN ' (revised)' ELSE '' END) AS text FROM tariff GROUP BY 1""", "tariff"))
def _index(spark, base):
    from quayside.operators.listing import upsert

    t = B.tariff(spark, base)
    text = F.concat_ws(" ", "hs_code", "description")
    old = t.groupBy("hs_code").agg(F.max(text).alias("text"))
    new = t.where("not active").groupBy("hs_code").agg(F.max(F.concat(text, F.lit(" (revised)"))).alias("text"))
    return upsert(old, new, ["hs_code"])
