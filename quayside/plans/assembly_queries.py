"""Evaluation, search, declaration and digest queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.common import rnd
from quayside.functions.hashing import digest
from quayside.operators import assembly as A
from quayside.operators import evaluation as E
from quayside.operators import history as H
from quayside.operators import search as S
from quayside.operators.ordered import numbered
from quayside.plans import bindings as B
from quayside.plans.bindings import oracle
from quayside.plans.catalog import query
from quayside.plans.rules_queries import TYPED, typed_documents, typed_fields
from quayside.plans.scoring_queries import AG, scored
from quayside.session import fresh_path
from quayside.sources import dims
from quayside.sources import writers as W
from quayside.sources.tables import read_table, spread


def _r(expr: str, n: int) -> str:
    return f"round(({expr})::DECIMAL(18,8), {n})::DOUBLE"


# --- evaluation --------------------------------------------------------------------------------------------------

def _one(g: str) -> str:
    return f"""CASE WHEN replace(replace({g}, ',', ''), ' ', '') = replace(replace(p, ',', ''), ' ', '') THEN 1.0 WHEN contains(p, {g}) OR contains({g}, p) THEN CASE WHEN length({g}) > 3 AND length(p) > 3 THEN 1.0 ELSE 0.8 END
        ELSE 1.0::DOUBLE - levenshtein({g}, p) / greatest(length({g}), length(p))::DOUBLE END"""


ANLS = f"""SELECT doc_id, source_id, field, weight, {_r('CASE WHEN p = ' + "''" + ' AND (g1 <> ' + "''" + ' OR g2 <> ' + "''" + ') THEN 0.0 WHEN p = ' + "''" + ' THEN 1.0 WHEN g1 = ' + "''" + ' AND g2 = ' + "''" + ' THEN 0.0 WHEN b >= 0.5 THEN b ELSE 0.0 END', 8)} AS score FROM (
    SELECT *, greatest(CASE WHEN g1 <> '' THEN {_one('g1')} END, CASE WHEN g2 <> '' THEN {_one('g2')} END)::DOUBLE AS b
    FROM (SELECT *, trim(lower(gt1)) AS g1, trim(lower(gt2)) AS g2, coalesce(trim(lower(pred)), '') AS p FROM b6))"""
ACC = f"SELECT field, count(*) AS n, {_r('sum(score::DECIMAL(18,8))::DOUBLE / count(*)', 6)} AS mean_score, max(weight) AS weight FROM anls GROUP BY 1"


def scored_pairs(spark, base, metric="levenshtein") -> DataFrame:
    pairs = B.eval_pairs(spark, base)
    # the document is part of the key: its sentences lie together and are matched where they are cut
    return E.match_truth(pairs.select("doc_id", "source_id", "field", "gt", "weight"), pairs.select("source_id", "doc_id", "field", "pred"), metric, ["source_id", "doc_id", "field"])


@query("gt_vs_pred", oracle("SELECT doc_id, field, score FROM anls", "b6", anls=ANLS))
def _pairs(spark, base):
    return scored_pairs(spark, base).select("doc_id", "field", "score")


@query("anls_eval", oracle("SELECT field, n, mean_score, weight, mean_score >= 0.85 AS passed FROM acc", "b6", anls=ANLS, acc=ACC))
def _anls(spark, base):
    return E.field_accuracy(scored_pairs(spark, base))


@query("anls_weighted", oracle(f"SELECT {_r('sum(mean_score::DECIMAL(18,8) * floor(weight * 2)::BIGINT)::DOUBLE / sum(floor(weight * 2))', 6)} AS weighted_anls, sum(mean_score * floor(weight * 2)) / sum(floor(weight * 2)) >= 0.85 AS passed FROM acc", "b6", anls=ANLS, acc=ACC))
def _weighted(spark, base):
    return E.weighted_accuracy(E.field_accuracy(scored_pairs(spark, base)))


@query("anls_indel")
def _indel(spark, base):
    return E.field_accuracy(scored_pairs(spark, base, "indel"))


@query("flag_accuracy", oracle(f"SELECT count(*) AS n, {_r('count(*) FILTER (starts_with(goods_code, ' + chr(39) + '28' + chr(39) + ') = (part % 100 = 28 AND supplier % 5 <> 0)) / count(*)::DOUBLE', 6)} AS accuracy FROM items", "items"))
def _flags(spark, base):
    items = B.tariff_items(spark, base)
    return E.flag_accuracy(items, F.col("goods_code"), (F.pmod("part", F.lit(100)) == 28) & (F.pmod("supplier", F.lit(5)) != 0))


_TRUTH = {
    "nomorBl": ["nomorBl", "booking_no"], "hs_code": ["hs_code", "hs_code_raw"], "beratKotor": ["beratKotor", "beratKotor_raw"],
}


def annotations(spark, base) -> DataFrame:
    """Annotation maps, one document each, printed from the lines."""
    d = B.documents_of_batches(spark, base)
    code = F.lpad(F.col("l_partkey").cast("string"), 8, "0")
    fields = F.create_map(
        F.lit("nomorBl"), F.concat(F.lit("HLCU"), F.col("l_suppkey").cast("string")), F.lit("booking_no"), F.when(F.pmod("l_partkey", F.lit(2)) == 0, F.lit("BK1")).otherwise(""),
        F.lit("hs_code"), code, F.lit("hs_code_raw"), F.concat(F.substring(code, 1, 4), F.lit("."), F.substring(code, 5, 4)), F.lit("beratKotor"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
    )
    note = F.struct(F.lit("Hapag-Lloyd").alias("carrier"), F.lit(2).alias("pages"), F.startswith(code, F.lit("28")).alias("insw_flag"), fields.alias("fields"))
    return d.select(F.to_json(F.create_map(F.col("doc_id"), note)).alias("note"))


@query("ground_truth_explode", oracle("""SELECT doc_key, carrier, restricted, field, accepted FROM (SELECT doc_id AS doc_key, 'Hapag-Lloyd' AS carrier, starts_with(c, '28') AS restricted, unnest(['nomorBl','hs_code','beratKotor']) AS field,
    unnest(['HLCU' || l_suppkey::VARCHAR || CASE WHEN l_partkey % 2 = 0 THEN '|BK1' ELSE '' END, c || '|' || left(c, 4) || '.' || right(c, 4), l_extendedprice::DECIMAL(18,2)::VARCHAR]) AS accepted FROM (SELECT *, lpad(l_partkey::VARCHAR, 8, '0') AS c FROM docs))""", "docs"))
def _truth(spark, base):
    out = dims.ground_truth(annotations(spark, base), "note", _TRUTH)
    return out.select("doc_key", "carrier", "restricted", "field", F.array_join("accepted", "|").alias("accepted"))


@query("training_set_assembly", oracle("""SELECT doc_id::VARCHAR AS id, 'real' AS origin, '{"title":' || to_json(gt1)::VARCHAR || '}' AS target FROM b6 WHERE split = 'train'
    UNION ALL (SELECT id, 'synthetic', target FROM (SELECT 'synth-' || lpad(o_orderkey::VARCHAR, 9, '0') AS id, '{"nomorBl":"BL' || o_orderkey::VARCHAR || '"}' AS target FROM orders) WHERE ('0x' || left(md5(id), 8))::BIGINT / 4294967296.0::DOUBLE < 0.2)""", "b6"))
def _training(spark, base):
    pairs = B.eval_pairs(spark, base)
    truth = pairs.select("doc_id", F.to_json(F.struct(F.col("gt")[0].alias("title"))).alias("target"))
    orders = read_table(spark, base, "orders", ["o_orderkey"])
    made = orders.select(
        F.concat(F.lit("synth-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("id"),
        F.to_json(F.struct(F.concat(F.lit("BL"), F.col("o_orderkey").cast("string")).alias("nomorBl"))).alias("target"),
    )
    return E.training_set(pairs.select("doc_id", "split"), truth, made, "Read the document").select("id", "origin", "target")


_MIX = """SELECT doc_id, source, hard FROM (SELECT doc_id, CASE WHEN doc_type = 'invoice' THEN 'real' ELSE 'synthetic' END AS source, l_partkey % 10 = 0 AS hard, ('0x' || left(md5(doc_id), 8))::BIGINT / 4294967296.0::DOUBLE AS place FROM docs)
    WHERE hard OR place < CASE source WHEN 'real' THEN 0.2 ELSE 0.8 END"""


@query("curriculum_mix", oracle(_MIX, "docs"))
def _mix(spark, base):
    d = B.documents_of_batches(spark, base)
    money = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    examples = d.select(
        "doc_id", F.when(F.col("doc_type") == "invoice", "real").otherwise("synthetic").alias("source"),
        F.when(F.pmod("l_partkey", F.lit(10)) == 0, F.concat(money, F.lit(" MTS"))).otherwise(money).alias("raw"), money.alias("normal"),
    )
    return E.curriculum_mix(examples, F.col("doc_id"), {"real": 0.2, "synthetic": 0.8}).select("doc_id", "source", "hard")


# --- search ---------------------------------------------------------------------------------------------------------

KNN = """SELECT q.vec_id AS query_id, c.vec_id AS match_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings c WHERE q.vec_id <> c.vec_id"""
RANKED = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, match_id) AS place FROM pairs"


def vectors(spark, base) -> DataFrame:
    return read_table(spark, base, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query("hs_topk", oracle(f"SELECT query_id, match_id, {_r('similarity', 3)} AS similarity, place FROM ranked WHERE place <= 3", pairs=KNN, ranked=RANKED))
def _topk(spark, base):
    v = vectors(spark, base)
    found = S.nearest(spread(v.drop("label"), "id"), v.drop("label"), 10).where("place <= 3")
    return found.select("query_id", "match_id", rnd(F.col("similarity"), 3).alias("similarity"), "place")


@query("hs_accuracy", oracle(f"""SELECT count(*) AS queries, {_r('count(*) FILTER (t1) / count(*)::DOUBLE', 6)} AS top1, {_r('count(*) FILTER (t3) / count(*)::DOUBLE', 6)} AS top3 FROM (SELECT query_id, bool_or(q.label = c.label AND place = 1) AS t1, bool_or(q.label = c.label AND place <= 3) AS t3
    FROM ranked JOIN embeddings q ON q.vec_id = query_id JOIN embeddings c ON c.vec_id = match_id GROUP BY 1)""", pairs=KNN, ranked=RANKED))
def _accuracy(spark, base):
    v = vectors(spark, base)
    return S.hit_rates(S.nearest(spread(v.drop("label"), "id"), v.drop("label"), 3), v)


_TOK = "SELECT id, token, count(*) AS tf FROM (SELECT {k} AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM {t}) WHERE token <> '' GROUP BY 1, 2"
_TEXT = {
    "e": _TOK.format(k="item_id", t="benchmark"), "a": _TOK.format(k="doc_id", t="documents"), "n": "SELECT count(*) AS n FROM benchmark", "df": "SELECT token, count(*) AS df FROM e GROUP BY 1",
    "ew": "SELECT id, token, tf * ln((n + 1) / (df + 1)::DOUBLE) AS w FROM e JOIN df USING (token), n", "aw": "SELECT id, token, tf * ln((n + 1) / (df + 1)::DOUBLE) AS w FROM a JOIN df USING (token), n",
    "en": "SELECT id, sqrt(sum(w*w)) AS norm FROM ew GROUP BY 1", "an": "SELECT id, sqrt(sum(w*w)) AS norm FROM aw GROUP BY 1",
    "pairs": "SELECT aw.id AS query_id, ew.id AS match_id, round(sum(aw.w / an.norm * ew.w / en.norm), 6) AS similarity FROM aw JOIN an ON aw.id = an.id JOIN ew ON aw.token = ew.token JOIN en ON ew.id = en.id WHERE an.norm > 0 AND en.norm > 0 GROUP BY 1, 2",
}


@query("text_knn", oracle("SELECT query_id, match_id, similarity, place FROM ranked WHERE place <= 3", **_TEXT, ranked=RANKED))
def _text(spark, base):
    docs = read_table(spark, base, "documents").select(F.col("doc_id").alias("id"), "text")
    catalogue = read_table(spark, base, "benchmark").select(F.col("item_id").alias("id"), "text")
    return S.text_nearest(spread(docs, "id"), catalogue, 3).select("query_id", "match_id", "similarity", "place")


# --- declarations ---------------------------------------------------------------------------------------------------

_FIRST = "SELECT batch_id, arg_min(packages, doc_id) AS packages, arg_min(fob_c, doc_id) / 100.0::DOUBLE AS fob, arg_min(cif_c, doc_id) / 100.0::DOUBLE AS cif, arg_min(currency, doc_id) AS currency, arg_min(nib, doc_id) AS nib, arg_min(npwp, doc_id) AS npwp, arg_min(bl_date, doc_id) AS bl_date, arg_min(port, doc_id) AS port FROM typed GROUP BY 1"


def headers(spark, base) -> DataFrame:
    return A.declaration_headers(typed_fields(spark, base))


@query("build_declaration", oracle("""SELECT batch_id, 0 AS part, '20' AS "kodeDokumen", '' AS "nomorBl", packages AS "jumlahKemasan", fob AS "nilaiFob", cif AS "nilaiCif", currency AS valuta, nib, npwp, strftime(bl_date, '%Y-%m-%d') AS "tglBl", port AS "kodePelabuhanBongkar", i.items, i.first_code, i.recommended
    FROM first JOIN (SELECT batch_id, count(*) AS items, arg_min(CASE WHEN l_partkey % 6 = 0 THEN 'REC' || row_number ELSE hs_code END, row_number) AS first_code, count(*) FILTER (l_partkey % 6 = 0) AS recommended FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY l_linenumber, doc_id) AS row_number FROM typed) GROUP BY 1) i USING (batch_id)""", "docs", typed=TYPED, first=_FIRST))
def _declaration(spark, base):
    d = typed_documents(spark, base)
    lines = d.select(
        "batch_id", "doc_id", F.col("l_linenumber").alias("line"), F.when(F.pmod("l_partkey", F.lit(6)) != 0, F.col("hs_code")).alias("hs_code"),
        F.lit("GOODS").alias("description"), F.col("packages").cast("string").alias("quantity"), F.lit("PCE").alias("unit"),
    )
    places = numbered(lines.select("batch_id", "doc_id", "line"), ["batch_id"], [F.col("line"), F.col("doc_id")], F.col("line"), "place")
    rec = places.select("batch_id", "place", F.concat(F.lit("REC"), F.col("place").cast("string")).alias("recommended"))
    built = A.build_declarations(headers(spark, base), A.declaration_items(lines, rec))
    e = F.col("entitas")[0]
    return built.select(
        "batch_id", "part", "kodeDokumen", "nomorBl", "jumlahKemasan", "nilaiFob", "nilaiCif", "valuta", e["nib"].alias("nib"), e["npwp"].alias("npwp"), "tglBl", "kodePelabuhanBongkar",
        F.size("barang").alias("items"), F.col("barang")[0]["posTarif"].alias("first_code"), F.size(F.filter("barang", lambda b: F.startswith(b["posTarif"], F.lit("REC")))).alias("recommended"),
    )


_PRIMARY = "SELECT * FROM typed QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY doc_id) = 1"
_FIXES = """SELECT batch_id, CASE WHEN batch_id % 4 = 0 THEN 'EUR' END AS currency_fix, CASE WHEN batch_id % 6 = 0 THEN 'VOY' || batch_id::VARCHAR END AS voyage_fix FROM first"""


def header_fixes(spark, base) -> DataFrame:
    """Corrections by rule: a currency, overruled by a later one, a voyage number nobody had read, and one without a value."""
    key = F.col("o_orderkey")
    o = read_table(spark, base, "orders", ["o_orderkey"])
    fix = lambda field, value, seq: F.struct(F.lit(field).alias("field"), value.alias("corrected_value"), F.lit(seq).alias("seq"))
    fixes = F.array(
        F.when(F.pmod(key, F.lit(4)) == 0, fix("currency", F.lit("GBP"), 1)), F.when(F.pmod(key, F.lit(4)) == 0, fix("currency", F.lit("EUR"), 2)),
        F.when(F.pmod(key, F.lit(6)) == 0, fix("voyage_number", F.concat(F.lit("VOY"), key.cast("string")), 3)), F.when(F.pmod(key, F.lit(5)) == 0, fix("nib", F.lit(None).cast("string"), 4)),
    )
    return o.select(key.alias("batch_id"), F.inline(F.array_compact(fixes)))


def whole_declarations(spark, base) -> DataFrame:
    """Declarations with corrections, number and the figures that travel along."""
    d = typed_documents(spark, base)
    lines = d.select("batch_id", "doc_id", F.col("l_linenumber").alias("line"), "hs_code", F.lit("GOODS").alias("description"), F.col("packages").cast("string").alias("quantity"), F.lit("PCE").alias("unit"))
    head = A.declaration_headers(A.primary_fields(typed_fields(spark, base), header_fixes(spark, base)))
    score = scored(spark, base).select("batch_id", F.col("score").cast("double").alias("crs_score"), rnd(F.col("agreement"), 6).alias("agent_agreement_rate"), F.lit(None).cast("string").alias("generated_at"))
    return A.build_declarations(head, A.declaration_items(lines), numbers=H.aju_sequence(B.batches(spark, base)).select("batch_id", "aju"), meta=score)


_WHOLE = {"typed": TYPED, "first": _PRIMARY, "fixes": _FIXES, **AG,
    "aju": "SELECT batch_id, strftime(created_at, '%Y%m%d%H%M%S') || lpad(company_id::VARCHAR, 6, '0') || lpad(row_number() OVER (PARTITION BY company_id ORDER BY created_at, batch_id)::VARCHAR, 6, '0') AS aju FROM b1",
    "whole": f"""SELECT batch_id, aju, coalesce(voyage_fix, '') AS voyage, coalesce(currency_fix, currency) AS currency, nib, packages, cif_c / 100.0::DOUBLE AS cif, score::DOUBLE AS crs_score, {_r('agreement', 6)} AS agent_agreement_rate, n
      FROM first JOIN fixes USING (batch_id) JOIN aju USING (batch_id) JOIN scored USING (batch_id) JOIN (SELECT batch_id, count(*) AS n FROM typed GROUP BY 1) USING (batch_id)"""}


@query("full_declaration", oracle("SELECT batch_id, aju, voyage, currency, nib, packages, cif, crs_score, agent_agreement_rate, n::INT AS items FROM (SELECT * EXCLUDE (packages), packages::BIGINT AS packages FROM whole)", "docs", "b1", "b3", **_WHOLE))
def _full(spark, base):
    built = whole_declarations(spark, base)
    return built.select(
        "batch_id", F.col("ajuNumber").alias("aju"), F.col("voyageNumber").alias("voyage"), F.col("valuta").alias("currency"), F.col("entitas")[0]["nib"].alias("nib"), F.col("jumlahKemasan").cast("bigint").alias("packages"),
        F.col("nilaiCif").alias("cif"), F.col("_meta.crs_score").alias("crs_score"), F.col("_meta.agent_agreement_rate").alias("agent_agreement_rate"), F.size("barang").alias("items"),
    )


@query("declaration_sink", oracle("SELECT batch_id, true AS readable, aju, currency, nib, crs_score FROM whole", "docs", "b1", "b3", **_WHOLE))
def _sink(spark, base):
    """Encrypted declarations as JSON lines behind a commit marker, read back and opened."""
    key = W.payload_key(spark, trial="0123456789abcdef0123456789abcdef")
    payloads = A.declaration_json(whole_declarations(spark, base))
    root = fresh_path(spark, "declarations")
    W.commit(payloads.select("batch_id", "part", A.encrypt_payload(F.col("payload"), key).alias("cipher"), F.sha2("payload", 256).alias("sha")), root)
    back = W.committed(spark, root, "batch_id bigint, part bigint, cipher string, sha string")
    opened = back.select("batch_id", "sha", A.decrypt_payload(F.col("cipher"), key).alias("opened"))
    part = lambda path, kind="string": F.get_json_object("opened", path).cast(kind)
    return opened.select(
        "batch_id", (F.sha2("opened", 256) == F.col("sha")).alias("readable"), part("$.ajuNumber").alias("aju"), part("$.valuta").alias("currency"),
        part("$.entitas[0].nib").alias("nib"), part("$._meta.crs_score", "double").alias("crs_score"),
    )


_HASH = """SELECT batch_id, sha256('{"cif":' || floor(cif_value)::BIGINT::VARCHAR || ',"company":' || company_id::VARCHAR || ',"importer":"' || importer || '","tier":"' || tier || '"}') AS content_hash FROM b1"""


def batch_hashes(spark, base) -> DataFrame:
    from quayside.functions.hashing import content_hash

    b = B.batches(spark, base)
    cols = {"cif": F.floor("cif_value"), "company": F.col("company_id"), "importer": F.col("importer"), "tier": F.col("tier")}
    return b.select("batch_id", content_hash(cols).alias("content_hash"))


@query("content_hash", oracle(_HASH, "b1"))
def _hash(spark, base):
    return batch_hashes(spark, base)


def _money(cents: str) -> str:
    return f"({cents} / 100.0::DOUBLE)::VARCHAR"


_JSON = f"""'{{"alamatEntitas":null,"beratBersih":null,"beratKotor":' || {_money('fob_c')} || ',"jumlahKemasan":' || packages::VARCHAR || ',"kodeDokumen":"20","kodePelabuhanBongkar":"' || port || '","kodePelabuhanMuat":"","namaEntitas":null,"namaKapal":"","nib":"' || nib
    || '","nilaiAsuransi":' || {_money('insurance_c')} || ',"nilaiCif":' || {_money('cif_c')} || ',"nilaiFob":' || {_money('fob_c')} || ',"nilaiFreight":' || {_money('freight_c')} || ',"nomorBl":"","nomorContainer":"","npwp":"' || npwp
    || '","tglArrival":"' || strftime(arrival, '%Y-%m-%d') || '","tglBl":"' || strftime(bl_date, '%Y-%m-%d') || '","valuta":"' || currency || '","voyageNumber":""}}'"""


@query("declaration_hash", oracle(f"SELECT batch_id, sha256({_JSON}) AS content_hash FROM first", "docs", typed=TYPED, first=_PRIMARY))
def _declaration_hash(spark, base):
    return A.declaration_hashes(headers(spark, base))


_TREE = {"l0": "SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY l_linenumber, doc_id) - 1 AS i, unhex(sha256(doc_id)) AS node FROM docs"}
for _n in range(1, 5):
    _TREE[f"l{_n}"] = (
        f"SELECT batch_id, i // 2 AS i, CASE WHEN max(size) = 1 THEN arg_min(node, i) ELSE unhex(sha256(arg_min(node, i) || arg_max(node, i))) END AS node "
        f"FROM (SELECT *, count(*) OVER (PARTITION BY batch_id) AS size FROM l{_n - 1}) GROUP BY 1, 2"
    )


@query("merkle_root", oracle("SELECT batch_id, lower(hex(node)) AS merkle_root FROM l4", "docs", **_TREE))
def _merkle(spark, base):
    docs = B.documents_of_batches(spark, base)
    rows = numbered(docs.select("batch_id", "doc_id", "l_linenumber"), ["batch_id"], [F.col("l_linenumber"), F.col("doc_id")], F.col("l_linenumber"), "n")
    return A.merkle_roots(rows.select("batch_id", "n", digest(F.col("doc_id")).alias("digest")))


@query("verify_anchor", oracle("SELECT batch_id, CASE WHEN rejected THEN false ELSE coalesce(priority <> '5-LOW', false) END AS verified, CASE WHEN rejected THEN 0 ELSE 1 END AS rejected_duplicates FROM b1", "b1"))
def _verify(spark, base):
    b = B.batches(spark, base).where("not rejected").select("batch_id", "priority")
    h = batch_hashes(spark, base)
    known = h.join(b, "batch_id")
    first = known.select("batch_id", F.when(F.col("priority") == "5-LOW", F.reverse("content_hash")).otherwise(F.col("content_hash")).alias("content_hash"), F.lit(1).alias("recorded"))
    again = known.select("batch_id", F.lit("other").alias("content_hash"), F.lit(2).alias("recorded"))
    return A.verify_anchors(h, first.unionByName(again))


