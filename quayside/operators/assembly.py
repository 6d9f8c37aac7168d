"""Declarations, their digests and the anchors that prove them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside import constants as K
from quayside.functions.hashing import content_hash
from quayside.functions.normalize import safe_float, safe_int
from quayside.operators.aliases import alias_rank, canonical_name
from quayside.operators.ordered import numbered

# Canonical field -> name in the declaration
HEADER_NAMES = {
    "bl_number": "nomorBl", "vessel_name": "namaKapal", "voyage_number": "voyageNumber", "port_loading_code": "kodePelabuhanMuat",
    "port_discharge_code": "kodePelabuhanBongkar", "bl_date": "tglBl", "arrival_date": "tglArrival", "gross_weight": "beratKotor",
    "net_weight": "beratBersih", "total_packages": "jumlahKemasan", "container_number": "nomorContainer", "currency": "valuta",
    "cif_value": "nilaiCif", "freight": "nilaiFreight", "insurance": "nilaiAsuransi", "fob_value": "nilaiFob",
}
ENTITY_NAMES = {"npwp": "npwp", "nib": "nib", "importer_name": "namaEntitas", "importer_address": "alamatEntitas"}
DECIMALS = ["gross_weight", "net_weight", "cif_value", "freight", "insurance", "fob_value"]
DEFAULTS = {"port_discharge_code": K.DEFAULT_DISCHARGE_PORT, "currency": "USD"}
PLACEHOLDER_CODE = "00000000"
DOCUMENT_CODE = "20"


def primary_fields(fields: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Fields of the first document of each batch, with the operator's corrections in their place.

    ``corrections(batch_id, field, corrected_value, seq)`` name fields of the declaration: the last one of a field counts, one without a value changes nothing,
    and a field that was never read enters. The corrected field stands before its aliases.

    Everything meets by batch alone, so that fields which lie by batch are not moved: no document sorts below the first one, and the fields of the first
    document, like the corrections of a batch, are packed before they meet."""
    first = fields.groupBy("batch_id").agg(F.min("doc_id").alias("first_doc")).hint("shuffle_hash")
    none = F.col("first_doc").isNull()  # no document of the batch has a name: nothing is kept, corrections enter
    kept = fields.join(first, "batch_id").where((F.col("doc_id") <= F.col("first_doc")) | none)
    if corrections is None:
        return kept.where(~none).select("batch_id", "doc_id", "field", "value")
    last = corrections.where("corrected_value IS NOT NULL").groupBy("batch_id", "field").agg(F.max_by("corrected_value", "seq").alias("value"))
    fixes = last.groupBy("batch_id").agg(F.collect_list(F.struct("field", "value")).alias("fixes"))
    read = kept.groupBy("batch_id", F.col("first_doc").alias("doc_id")).agg(F.collect_list(F.when(~none, F.struct("field", "value"))).alias("read"))
    fixed = lambda r: F.exists(F.col("fixes"), lambda f: F.coalesce(f["field"] == r["field"], F.lit(False)))
    both = read.join(fixes, "batch_id", "left").withColumn("fixes", F.coalesce("fixes", F.array().cast(fixes.schema["fixes"].dataType)))
    return both.select("batch_id", "doc_id", F.inline(F.concat(F.filter("read", lambda r: ~fixed(r)), F.col("fixes"))))


def declaration_headers(fields: DataFrame) -> DataFrame:
    """One row per batch with header and importer, from the canonical values of its first document."""
    wanted = list(HEADER_NAMES) + list(ENTITY_NAMES)
    known = fields.withColumn("name", canonical_name(F.col("field"))).where(F.col("name").isin(wanted) & F.col("value").isNotNull())
    first = known.groupBy("batch_id", "name").agg(F.min(F.struct("doc_id", alias_rank(F.col("field")).alias("rank"), "value")).alias("f"))
    wide = first.groupBy("batch_id").agg(*[F.max(F.when(F.col("name") == n, F.col("f.value"))).alias(n) for n in wanted])
    out = []
    for name, label in {**HEADER_NAMES, **ENTITY_NAMES}.items():
        c = F.col(name)
        if name in DECIMALS:
            c = safe_float(c)
        elif name == "total_packages":
            c = safe_int(c)
        elif name in HEADER_NAMES:
            c = F.coalesce(c, F.lit(DEFAULTS.get(name, "")))
        out.append(c.alias(label))
    return wide.select("batch_id", F.lit(DOCUMENT_CODE).alias("kodeDokumen"), *out)


def declaration_items(docs: DataFrame, recommendations: DataFrame | None = None) -> DataFrame:
    """Goods lines in order; a line without code or text is left out, a missing code takes the recommendation at its place."""
    kept = docs.where(F.col("hs_code").isNotNull() | F.col("description").isNotNull())
    lines = numbered(kept, ["batch_id"], [F.col("line"), F.col("doc_id")], F.col("line"), "seri")
    if recommendations is not None:
        lines = lines.join(recommendations.select("batch_id", F.col("place").alias("seri"), "recommended"), ["batch_id", "seri"], "left")
    else:
        lines = lines.withColumn("recommended", F.lit(None).cast("string"))
    open_code = F.coalesce("hs_code", F.lit(PLACEHOLDER_CODE)) == PLACEHOLDER_CODE
    return lines.select(
        "batch_id", "seri", F.when(open_code, F.coalesce("recommended", F.lit(PLACEHOLDER_CODE))).otherwise(F.col("hs_code")).alias("posTarif"),
        F.col("description").alias("uraianBarang"), F.coalesce("quantity", F.lit("1")).alias("jumlahSatuan"), F.coalesce("unit", F.lit("PKG")).alias("satuanBarang"),
        (open_code & F.col("recommended").isNotNull()).alias("hs_recommended"),
    )


def build_declarations(headers: DataFrame, items: DataFrame, page_size: int = 1000, numbers: DataFrame | None = None, meta: DataFrame | None = None) -> DataFrame:
    """Nested declarations. A declaration with more lines than a page goes out in numbered parts, so no array is unbounded.

    ``numbers(batch_id, aju)`` gives declaration numbers (empty before one is assigned), ``meta(batch_id, crs_score, agent_agreement_rate, generated_at)`` the figures that
    travel with a declaration. The time is a column of the caller's: no clock is read here, so that a repeated run builds the same rows."""
    line = F.struct("seri", "posTarif", "uraianBarang", "jumlahSatuan", "satuanBarang")
    parts = items.groupBy("batch_id", F.floor((F.col("seri") - 1) / page_size).alias("part")).agg(F.array_sort(F.collect_list(line)).alias("barang"))
    default = F.array(
        F.struct(
            F.lit(1).cast("bigint").alias("seri"), F.lit(PLACEHOLDER_CODE).alias("posTarif"), F.lit("UNCLASSIFIED").alias("uraianBarang"),
            F.lit("1").alias("jumlahSatuan"), F.lit("PKG").alias("satuanBarang"),
        )
    )
    entity = F.array(F.struct(F.lit("IMPORTIR").alias("tipeEntitas"), *ENTITY_NAMES.values()))
    spark = headers.sparkSession
    numbers = spark.createDataFrame([], headers.select("batch_id").schema.add("aju", "string")) if numbers is None else numbers
    meta = spark.createDataFrame([], headers.select("batch_id").schema.add("crs_score", "double").add("agent_agreement_rate", "double").add("generated_at", "string")) if meta is None else meta
    about = F.struct(F.col("generated_at"), F.col("batch_id").cast("string").alias("batch_id"), F.col("crs_score"), F.col("agent_agreement_rate"))
    whole = headers.join(parts, "batch_id", "left").join(numbers.select("batch_id", "aju"), "batch_id", "left").join(meta.select("batch_id", "crs_score", "agent_agreement_rate", "generated_at"), "batch_id", "left")
    return whole.select(
        "batch_id", F.coalesce("part", F.lit(0)).alias("part"), "kodeDokumen", F.coalesce("aju", F.lit("")).alias("ajuNumber"), *HEADER_NAMES.values(), entity.alias("entitas"),
        F.coalesce("barang", default).alias("barang"), about.alias("_meta"),
    )


def declaration_json(declarations: DataFrame) -> DataFrame:
    body = [c for c in declarations.columns if c not in ("batch_id", "part")]
    return declarations.select("batch_id", "part", F.to_json(F.struct(*body)).alias("payload"))


def encrypt_payload(payload: Column, key: Column) -> Column:
    """AES-GCM of the payload, base64 text; nonce first."""
    return F.base64(F.aes_encrypt(payload, key, F.lit("GCM")))


def decrypt_payload(cipher: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(cipher), key, F.lit("GCM")).cast("string")


def declaration_hashes(headers: DataFrame) -> DataFrame:
    """Digest of the canonical JSON of each declaration header; no clock value enters it."""
    return headers.select("batch_id", content_hash({c: F.col(c) for c in headers.columns if c != "batch_id"}).alias("content_hash"))


# --- Merkle trees ------------------------------------------------------------------------------------------

LEVELS = 10  # leaves are folded in blocks of 2**LEVELS


def _fold(leaves: Column, levels: int, only_block: Column) -> Column:
    """Fold an array of digests ``levels`` times, an odd last one paired with itself; a lone block stops at its root."""

    def pair_up(nodes: Column, _: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")),
            lambda i: F.unhex(F.sha2(F.concat(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.get(nodes, i * 2))), 256)),
        )
        return F.when(only_block & (F.size(nodes) == 1), nodes).otherwise(pairs)

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.lit(levels)), leaves, pair_up), 1)


def merkle_roots(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Root per batch over its numbered leaves (batch_id, n from 1, digest as hex).

    A block of 2**levels neighbouring leaves is folded inside one row, so the number of rounds
    grows with the logarithm of the largest batch and no group exceeds the block size.
    """
    sizes = leaves.groupBy("batch_id").agg(F.max("n").alias("size"))
    largest = sizes.agg(F.max("size")).first()[0] or 1
    rounds = max(1, math.ceil(math.log(largest, 2) / levels - 1e-9)) if largest > 1 else 1
    block = 2**levels
    nodes = leaves.select("batch_id", (F.col("n") - 1).alias("i"), F.unhex("digest").alias("node"))
    nodes = nodes.join(sizes, "batch_id")
    for _ in range(rounds):
        grouped = nodes.groupBy("batch_id", "size", F.floor(F.col("i") / block).alias("b")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "node"))), lambda x: x["node"]).alias("nodes")
        )
        # "only" has its own name: inside the fold a name is looked up among the new columns first
        marked = grouped.withColumn("only", F.col("size") <= block)
        nodes = marked.select(
            "batch_id", F.ceil(F.col("size") / block).alias("size"), F.col("b").alias("i"), _fold(F.col("nodes"), levels, F.col("only")).alias("node")
        )
    return nodes.select("batch_id", F.lower(F.hex("node")).alias("merkle_root"))


def verify_anchors(current: DataFrame, anchors: DataFrame) -> DataFrame:
    """Does the recorded digest still hold? The first record of a batch counts, an unknown batch is not verified."""
    first = anchors.groupBy("batch_id").agg(F.min_by("content_hash", "recorded").alias("anchored"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return current.join(first, "batch_id", "left").select(
        "batch_id", F.coalesce(F.col("content_hash") == F.col("anchored"), F.lit(False)).alias("verified"), F.coalesce("duplicates", F.lit(0)).alias("rejected_duplicates")
    )
