"""Projections, searches, routing and set operations."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.functions import extract as X
from quayside.functions import validate as V
from quayside.operators import listing as L
from quayside.operators.ordered import pages
from quayside.operators.voting import majority_vote
from quayside.plans import bindings as B
from quayside.plans.bindings import oracle
from quayside.plans.catalog import query
from quayside.plans.voting_queries import by_batch, rec_sql
from quayside.session import fresh_path
from quayside.sources import writers as W
from quayside.sources.tables import read_table

AS_OF = "1998-09-01 12:00:00"


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


@query("scan_batches", "SELECT o_orderkey AS batch_id, o_orderstatus AS status, o_totalprice AS cif_value FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000")
def _scan(spark, base):
    t = read_table(spark, base, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"], "o_orderstatus = 'F' and o_totalprice > 150000")
    return t.toDF("batch_id", "status", "cif_value")


@query("list_batches", oracle("SELECT batch_id, company_id, status, cif_value FROM b1 ORDER BY created_at DESC, batch_id LIMIT 20 OFFSET 40", "b1"))
def _list(spark, base):
    return L.list_batches(B.batches(spark, base), limit=20, offset=40).select("batch_id", "company_id", "status", "cif_value")


@query("batch_detail", rec_sql("""SELECT b.batch_id, b.status, coalesce(d.documents, 0) AS documents, coalesce(d.document_types, 0) AS document_types, coalesce(f.fields, 0) AS fields,
    coalesce(f.filled, 0) AS filled, coalesce(f.disputed, 0) AS disputed FROM b1 b
    LEFT JOIN (SELECT batch_id, count(*) AS documents, count(DISTINCT doc_type) AS document_types FROM docs GROUP BY 1) d ON b.batch_id = d.batch_id
    LEFT JOIN (SELECT batch_id, count(*) AS fields, count(value) AS filled, count(*) FILTER (disagreement) AS disputed FROM rec GROUP BY 1) f ON b.batch_id = f.batch_id""", "b1", "docs"))
def _detail(spark, base):
    return L.batch_detail(B.batches(spark, base).select("batch_id", "status"), B.documents_of_batches(spark, base), by_batch(spark, base, majority_vote))


@query("batch_document_pages", oracle("""SELECT batch_id, (n - 1) // 5 AS page, count(*) AS documents, string_agg(doc_id, ',' ORDER BY n) AS listing
    FROM (SELECT batch_id, doc_id, row_number() OVER (PARTITION BY batch_id ORDER BY l_linenumber, doc_id) AS n FROM docs) GROUP BY 1, 2""", "docs"))
def _pages(spark, base):
    docs = B.documents_of_batches(spark, base)
    paged = pages(docs, ["batch_id"], [F.col("l_linenumber"), F.col("doc_id")], F.col("l_linenumber"), F.col("doc_id"), size=5)
    return paged.select("batch_id", "page", F.size("items").alias("documents"), F.array_join("items", ",").alias("listing"))


@query("status_search", oracle("SELECT batch_id, status, importer FROM b1 WHERE status = 'accepted' AND (contains(lower('PIB-' || upper(left(batch_id::VARCHAR, 8))), '77') OR contains(lower(importer), '77'))", "b1"))
def _search(spark, base):
    return L.status_search(B.batches(spark, base), "accepted", "77").select("batch_id", "status", "importer")


@query("audit_search", oracle("SELECT event_id, batch_id, action, field_name FROM b4 WHERE contains(lower(action), 'eld_1') OR contains(lower(field_name), 'eld_1') OR contains(batch_id::VARCHAR, 'eld_1')", "b4"))
def _audit(spark, base):
    return L.text_search(B.events(spark, base), "ELD_1", ["action", "field_name", "batch_id"]).select("event_id", "batch_id", "action", "field_name")


@query("last_write_fields", oracle("SELECT batch_id, field, arg_max(value, doc_id || engine) AS value, arg_max(engine, doc_id || engine) AS engine FROM (SELECT * FROM b2 WHERE value IS NOT NULL) GROUP BY 1, 2", "b2"))
def _last(spark, base):
    return by_batch(spark, base, lambda obs: L.last_write(obs.where("value is not null"), ["batch_id", "field"], ["value", "engine"], ["doc_id", "engine"]))


_PROFILES = """SELECT c_custkey AS user_id, c_custkey AS company_id, CASE WHEN c_acctbal > 9990 THEN 'supervisor' WHEN c_acctbal > 0 THEN 'importer' ELSE 'operator' END AS role FROM customer"""


@query("tenant_filter", oracle("""SELECT 'user ' || user_id::VARCHAR AS viewer, batch_id, status FROM b1 JOIN prof ON b1.company_id = prof.company_id WHERE role NOT IN ('admin', 'supervisor')
    UNION ALL SELECT 'staff', batch_id, status FROM b1""", "b1", prof=_PROFILES))
def _tenant(spark, base):
    return L.visible_to(B.batches(spark, base), profiles(spark, base)).select("viewer", "batch_id", "status")


def profiles(spark, base) -> DataFrame:
    c = read_table(spark, base, "customer", ["c_custkey", "c_acctbal"])
    role = F.when(F.col("c_acctbal") > 9990, "supervisor").when(F.col("c_acctbal") > 0, "importer").otherwise("operator")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("company_id"), role.alias("role"))


@query("visible_batches", oracle("""SELECT batch_id, status FROM b1 WHERE company_id IN (SELECT company_id FROM prof WHERE user_id = 7) OR EXISTS (SELECT 1 FROM prof WHERE user_id = 7 AND role IN ('admin', 'supervisor'))""", "b1", prof=_PROFILES))
def _visible(spark, base):
    return L.visible_batches(B.batches(spark, base), profiles(spark, base), 7).select("batch_id", "status")


@query("batch_detail_pages", rec_sql("""SELECT batch_id, child, (n - 1) // 1000 AS page, count(*) AS rows, sha256(string_agg(item, chr(10) ORDER BY n)) AS sha FROM (
    SELECT batch_id, 'documents' AS child, '{"doc_id":"' || doc_id || '","doc_type":"' || doc_type || '"}' AS item, row_number() OVER (PARTITION BY batch_id ORDER BY doc_id) AS n FROM docs
    UNION ALL SELECT batch_id, 'fields', '{"doc_id":"' || doc_id || '","field":"' || field || '","value":' || CASE WHEN value IS NULL THEN 'null' ELSE '"' || value || '"' END || ',"level":"' || level || '"}', row_number() OVER (PARTITION BY batch_id ORDER BY doc_id, field) FROM rec
    UNION ALL SELECT batch_id, 'validations', '{"doc_id":"' || doc_id || '","field":"hs_code","passed":' || CASE WHEN regexp_full_match(value, '[0-9]{8}') THEN 'true' ELSE 'false' END || '}', row_number() OVER (PARTITION BY batch_id ORDER BY doc_id) FROM rec WHERE field = 'hs_code' AND value IS NOT NULL
    ) GROUP BY ALL""", "docs"))
def _detail_pages(spark, base):
    parts = []
    for docs, crowded in zip(B.documents_by_batch(spark, base), (False, True)):
        rec = majority_vote(B.shape_observations(docs))
        checks = majority_vote(B.shape_observations(docs, ["hs_code"])).where("field = 'hs_code' AND value IS NOT NULL").select("batch_id", "doc_id", "field", V.valid_hs(F.col("value")).alias("passed"))
        children = {
            "documents": (docs.select("batch_id", "doc_id", "doc_type"), ["doc_id"]),
            "fields": (rec.select("batch_id", "doc_id", "field", "value", "level"), ["doc_id", "field"]), "validations": (checks, ["doc_id"]),
        }
        parts.append(L.detail_pages(children, crowded=crowded))
    found = functools.reduce(DataFrame.unionByName, parts)
    return found.select("batch_id", "child", "page", F.size("items").cast("long").alias("rows"), F.sha2(F.array_join("items", "\n"), 256).alias("sha"))


@query("completeness", rec_sql("""SELECT batch_id, count(DISTINCT CASE WHEN field IN ('total_packages', 'gross_weight') AND value IS NOT NULL AND value NOT IN ('', '0', '0.0') THEN field END) / 6.0::DOUBLE AS completeness FROM rec GROUP BY 1"""))
def _complete(spark, base):
    return by_batch(spark, base, lambda obs: L.completeness(majority_vote(obs)))


@query("route_document", oracle("""SELECT doc_id, CASE WHEN n_chars > 1000 AND q >= 0.95 THEN 'FAST_PATH' WHEN q >= 0.5 THEN 'STANDARD' ELSE 'DEGRADED' END AS route, n_chars >= 250 AND n_chars / page_count::DOUBLE >= 80 AS dense
    FROM (SELECT *, coalesce(quality, 0.6::DOUBLE) AS q FROM b5)""", "b5"))
def _route(spark, base):
    d = B.text_documents(spark, base)
    q = F.coalesce(F.col("quality").cast("double"), F.lit(0.6))
    return d.select("doc_id", L.route_document(F.col("n_chars") > 1000, q).alias("route"), L.dense_text(F.col("n_chars"), F.col("page_count"), F.lit(1.0)).alias("dense"))


@query("page_filter", oracle("""SELECT doc_id, page, kind AS page_type FROM (SELECT *, CASE WHEN page = 1 THEN 'MAIN' WHEN regexp_matches(text, '\\bDEFINITIONS\\b') THEN 'TC' WHEN density > 0.15 THEN 'TC' WHEN density > 0.05 THEN 'ATTACHMENT' ELSE 'UNKNOWN' END AS kind
      FROM (SELECT doc_id, text, unnest(range(1, page_count + 1)) AS page, length(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g')) / (page_count * 30000.0::DOUBLE) AS density FROM b5)) WHERE kind IN ('MAIN', 'ATTACHMENT')""", "b5"))
def _pagetypes(spark, base):
    d = B.text_documents(spark, base)
    density = X.text_chars(F.col("text")) / (F.col("page_count") * F.lit(30000.0))
    p = d.select("doc_id", density.alias("density"), F.col("text").rlike(r"\bDEFINITIONS\b").alias("clauses"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("page_count"))).alias("page"))
    kind = L.page_type(F.col("page"), F.col("density"), F.when(F.col("clauses"), "DEFINITIONS").otherwise(""))
    return L.keep_pages(p.select("doc_id", "page", kind.alias("page_type")))


@query("review_gate", oracle("""SELECT batch_id, flagged OR score < 70 OR prob >= 0.35 AS needs_review, score < 55 AS blocked FROM (SELECT batch_id, critical > 0 AS flagged, doc_quality * 100 - warnings * 10 AS score, 1 - consistency AS prob FROM b3)""", "b3"))
def _gate(spark, base):
    b = B.batch_scores(spark, base)
    cols = L.review_gate(F.col("doc_quality") * 100 - F.col("warnings") * 10, 1 - F.col("consistency"), F.col("critical") > 0)
    return b.select("batch_id", *[c.alias(n) for n, c in cols.items()])


@query("submit_checklist", oracle("""SELECT *, criticals_pass AND score_ok AND nib_ok AND npwp_ok AND vessel_ok AND permits_ok AS can_submit FROM (SELECT batch_id, critical = 0 AS criticals_pass, doc_quality * 100 - warnings * 12 >= 55 AS score_ok,
    package_count % 5 <> 0 AS nib_ok, package_count % 7 <> 0 AS npwp_ok, vessel_status <> 'critical' AS vessel_ok, coalesce(gaps, 0) = 0 AS permits_ok FROM b3 LEFT JOIN
    (SELECT batch_id AS bid, count(*) AS gaps FROM items WHERE NOT has_permit AND left(goods_code, 2) IN ('01','04','07','08','10','21','28','30','61','62','84','85','93','97') GROUP BY 1) ON batch_id = bid)""", "b3", "items"))
def _checklist(spark, base):
    from quayside.operators.tariff import restricted

    b = B.batch_scores(spark, base)
    gaps = restricted(B.tariff_items(spark, base), "goods_code").where("not has_permit").groupBy("batch_id").agg(F.count(F.lit(1)).alias("gaps"))
    b = b.join(gaps, "batch_id", "left")
    digits = F.when(F.pmod("package_count", F.lit(5)) == 0, "81200123456").otherwise("8120012345678")
    row = {
        "critical": F.col("critical"), "score": F.col("doc_quality") * 100 - F.col("warnings") * 12, "nib": digits,
        "npwp_ok": F.pmod("package_count", F.lit(7)) != 0, "vessel_status": F.col("vessel_status"), "permit_gaps": F.coalesce("gaps", F.lit(0)),
    }
    return b.select("batch_id", *[c.alias(n) for n, c in L.submit_checklist(row).items()])


@query("age_bucket", oracle(f"""SELECT batch_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m::VARCHAR || ' min ago' WHEN m // 60 < 24 THEN (m // 60)::VARCHAR || ' hr ago' ELSE (m // 60 // 24)::VARCHAR || ' d ago' END AS age
    FROM (SELECT batch_id, greatest(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at + to_minutes((batch_id * 37 % 3000)::INT))) / 60000000), 0)::BIGINT AS m FROM b1)""", "b1"))
def _age(spark, base):
    b = B.batches(spark, base)
    ts = F.col("created_at") + F.make_interval(mins=F.pmod(F.col("batch_id") * 37, F.lit(3000)).cast("int"))
    return b.select("batch_id", L.age_label(ts, as_of()).alias("age"))


@query("status_flags", oracle("""SELECT event_id, action IN ('uploaded','preprocessing','ocr_running','extracting','validating') AS is_processing,
    CASE WHEN action IN ('uploaded','preprocessing') THEN 'Processing OCR' ELSE action END AS status_label, 'PIB-' || upper(left(batch_id::VARCHAR, 8)) AS reference FROM b4""", "b4"))
def _flags(spark, base):
    return B.events(spark, base).select("event_id", *[c.alias(n) for n, c in L.status_flags(F.col("action"), F.col("batch_id")).items()])


@query("next_status", oracle("""SELECT batch_id, CASE WHEN package_count = 0 THEN 'error' WHEN critical > 0 THEN 'review_ready' WHEN warnings = 0 THEN 'validated' ELSE 'ocr_complete' END AS status FROM b3""", "b3"))
def _next(spark, base):
    b = B.batch_scores(spark, base)
    return b.select("batch_id", L.next_status(F.col("package_count") == 0, F.lit(True), F.col("warnings") == 0, F.col("critical") > 0).alias("status"))


@query("check_domain", oracle("""SELECT batch_id, 'tier' AS "check", tier AS value FROM b1 WHERE tier <> 'enterprise' UNION ALL SELECT batch_id, 'priority', priority FROM b1 WHERE priority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
    UNION ALL SELECT batch_id, 'amount', 'above' FROM b1 WHERE NOT (cif_value BETWEEN 1000 AND 200000) UNION ALL SELECT batch_id, 'status', status FROM b1 WHERE status = 'unknown'""", "b1"))
def _domain(spark, base):
    b = B.batches(spark, base)
    c = F.col
    return L.domain_violations(b, "batch_id", {
        "tier": (c("tier") == "enterprise", c("tier")),
        "priority": (c("priority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), c("priority")),
        "amount": (c("cif_value").between(1000, 200000), F.lit("above")),
        "status": (c("status").isin(K.BATCH_STATUSES), c("status")),
    })


# --- set operations and keyed writes --------------------------------------------------------------------------

@query("replace_by_key", oracle("""SELECT batch_id, status, cif_value FROM b1 WHERE batch_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    UNION ALL SELECT l_orderkey, 'line', l_extendedprice FROM lineitem WHERE l_returnflag = 'R'""", "b1"))
def _replace(spark, base):
    old = B.batches(spark, base).select("batch_id", "status", "cif_value")
    new = read_table(spark, base, "lineitem", ["l_orderkey", "l_extendedprice"], "l_returnflag = 'R'")
    new = new.select(F.col("l_orderkey").alias("batch_id"), F.lit("line").alias("status"), F.col("l_extendedprice").alias("cif_value"))
    path = fresh_path(spark, "replaced")
    for rows in (old, new):  # the table as it was, then the rows that take its place; read back from the files
        W.replace_keys(rows, path, ["batch_id"])
    return spark.read.parquet(path).drop(W.BUCKET)


_INCOMING = """SELECT l_orderkey + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 100000000 END AS batch_id, 'new' AS status, max(l_extendedprice) AS cif_value FROM lineitem GROUP BY 1"""


def _incoming(spark, base):
    li = read_table(spark, base, "lineitem", ["l_orderkey", "l_returnflag", "l_extendedprice"])
    key = F.col("l_orderkey") + F.when(F.col("l_returnflag") == "R", 0).otherwise(100000000)
    return li.groupBy(key.alias("batch_id")).agg(F.lit("new").alias("status"), F.max("l_extendedprice").alias("cif_value"))


@query("upsert", oracle("""SELECT coalesce(n.batch_id, o.batch_id) AS batch_id, coalesce(n.status, o.status) AS status, coalesce(n.cif_value, o.cif_value) AS cif_value FROM b1 o FULL JOIN inc n ON o.batch_id = n.batch_id""", "b1", inc=_INCOMING))
def _upsert(spark, base):
    return L.upsert(B.batches(spark, base).select("batch_id", "status", "cif_value"), _incoming(spark, base), ["batch_id"])


@query("upsert_do_nothing", oracle("SELECT batch_id, status, cif_value FROM b1 UNION ALL SELECT * FROM inc WHERE batch_id NOT IN (SELECT batch_id FROM b1)", "b1", inc=_INCOMING))
def _upsert_nothing(spark, base):
    return L.upsert(B.batches(spark, base).select("batch_id", "status", "cif_value"), _incoming(spark, base), ["batch_id"], "nothing")


@query("new_rows_only", oracle("SELECT * FROM inc WHERE batch_id NOT IN (SELECT batch_id FROM b1)", "b1", inc=_INCOMING))
def _new_rows(spark, base):
    return L.new_rows_only(B.batches(spark, base), _incoming(spark, base), ["batch_id"])


_PARTIAL = f"""SELECT batch_id, NOT (status IN ('accepted', 'rejected', 'failed')) AND (epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 3600 > CASE WHEN tier = 'sme' THEN 48 ELSE 168 END AS gone FROM b1"""


@query("expired_batches", oracle("SELECT batch_id, CASE WHEN gone THEN 'removed' ELSE 'kept' END AS fate FROM p", "b1", p=_PARTIAL))
def _expired(spark, base):
    b = B.batches(spark, base).withColumn("partial", F.col("tier") == "sme")
    gone = b.where(L.expired(b, as_of())).select("batch_id")
    kept = b.join(gone, "batch_id", "left_anti").select("batch_id", F.lit("kept").alias("fate"))
    return gone.select("batch_id", F.lit("removed").alias("fate")).unionByName(kept)


@query("union_corpora", "SELECT doc_id AS id, 'document' AS origin, length(text) AS chars FROM documents UNION ALL SELECT item_id, 'benchmark', length(text) FROM benchmark UNION ALL SELECT page_id, 'page', length(html) FROM pages")
def _union(spark, base):
    d = read_table(spark, base, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("origin"), F.length("text").cast("bigint").alias("chars"))
    b = read_table(spark, base, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"), F.length("text").cast("bigint").alias("chars"))
    p = read_table(spark, base, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("origin"), F.length("html").cast("bigint").alias("chars"))
    return d.unionByName(b).unionByName(p)


@query("split_leakage", oracle("SELECT sha256(gt1) AS sha FROM b6 WHERE split = 'train' INTERSECT SELECT sha256(gt1) FROM b6 WHERE split = 'val'", "b6"))
def _leak(spark, base):
    pairs = B.eval_pairs(spark, base).select("split", F.sha2(F.col("gt")[0], 256).alias("sha"))
    return pairs.where("split = 'train'").select("sha").intersect(pairs.where("split = 'val'").select("sha"))


@query("poll_batch", oracle("SELECT batch_id, status, company_id FROM b1 WHERE status NOT IN ('accepted', 'rejected', 'failed') ORDER BY created_at, batch_id LIMIT 50", "b1"))
def _poll(spark, base):
    b = B.batches(spark, base).where(~F.col("status").isin(K.TERMINAL_STATUSES))
    return b.orderBy("created_at", "batch_id").limit(50).select("batch_id", "status", "company_id")
