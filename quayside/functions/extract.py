"""Reading labelled values out of document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.common import as_number, digits, once
from quayside.functions.normalize import folded, locale_float
from quayside.functions.validate import field_format_valid

# --- Fixed values: label patterns; group 1 is the value, the first pattern that matches wins ----------
GENERAL_PATTERNS = {
    "importer_npwp": [r"\b(?:NPWP|Tax\s*ID|TIN)[^\n0-9]*([0-9.\- ]{10,24})"],
    "total_packages": [r"\b(?:total\s+packages|packages|jumlah\s+koli|koli)[^\n0-9]*(\d{1,7})"],
    "gross_weight": [r"\b(?:gross\s+weight|gross\s+wt|berat\s+kotor)[^\n0-9]*([0-9,.]+)"],
    "cif_value": [r"\b(?:CIF|total\s+amount|invoice\s+value|nilai\s+cif)[^\n0-9]*(?:[A-Z]{3})?\s*([0-9,.]+)"],
    "currency": [r"\b(?:currency|curr|mata\s+uang)[^\nA-Z]*([A-Z]{3})\b", r"\b(USD|IDR|SGD|EUR|JPY|CNY)\b"],
    "importer_name": [r"\b(?:importer|consignee|buyer|notify\s+party)[^\n:]*[:\-]\s*([A-Z0-9][A-Z0-9 .,&'/-]{3,80})"],
}
FALLBACK_PATTERNS = {
    "importer_npwp": (r"\b(?:NPWP|Tax\s*ID)\D*([0-9.\- ]{10,24})", 1),
    "total_packages": (r"\b(?:total\s+packages|packages|koli)\D*(\d{1,7})", 1),
    "gross_weight": (r"\b(?:gross\s+weight|gross)\D*([0-9,.]+)", 1),
    "currency": (r"\b(?:CIF|total\s+amount|invoice\s+value)\D*([A-Z]{3})?\s*([0-9,.]+)", 1),
    "cif_value": (r"\b(?:CIF|total\s+amount|invoice\s+value)\D*([A-Z]{3})?\s*([0-9,.]+)", 2),
}
FALLBACK_CONFIDENCE = 0.68
SHARED_PATTERNS = {
    "bl_number": r"\bB/L\s+No\.\s*([A-Z0-9\-]+)",
    "importer_name": r"(?:Consignee|Buyer\s*/\s*Importer)\s+(.+?)(?:\s+Vessel|\s+Date|\s+PO\s+No\.|\n)",
    "exporter_name": r"(?:Shipper|Seller\s*/\s*Exporter|Exporter)\s+(.+?)(?:\s+B/L\s+No\.|\s+Invoice\s+No\.|\s+Packing\s+List\s+No\.|\n)",
}
TYPED_PATTERNS = {
    "bill_of_lading": {
        "vessel_name": r"\bVessel\s+(.+?)(?:\n|$)",
        "voyage_number": r"\bVoyage\s+No\.\s*([A-Z0-9\-]+)",
        "port_of_loading": r"\bPort of Loading\s+(.+?)\s+Port of Discharge",
        "port_of_discharge": r"\bPort of Discharge\s+([\s\S]+?)(?:Place of Delivery|Freight Terms)",
        "freight_terms": r"\bFreight Terms\s+(.+?)(?:\n|Incoterm)",
        "incoterms": r"\bIncoterm\s+([A-Z]{3})\b",
        "bl_date": r"(?:Shipped on Board Date|Place and Date of Issue\s+\S+,\s*)\s*([0-9]{1,2}-[A-Z]{3}-[0-9]{4})",
    },
    "packing_list": {"bl_date": r"\bDate\s+([0-9]{1,2}-[A-Z]{3}-[0-9]{4})"},
    "invoice": {
        "bl_date": r"\bInvoice Date\s+([0-9]{1,2}-[A-Z]{3}-[0-9]{4})",
        "importer_nib": r"\bImporter NIB\s+([0-9]{10,20})",
        "importer_npwp": r"\bImporter NPWP\s+([0-9.\-]+)",
        "currency": r"\bCurrency\s+([A-Z]{3})\b",
        "incoterms": r"\bIncoterm\s+([A-Z]{3})\b",
        "port_of_discharge": r"\bPort of Discharge\s+([\s\S]+?)(?:Item Description)",
        "fob_value": r"\bFOB Value\s+[A-Z]{3}\s+([0-9,.]+)",
        "freight_value": r"\bFreight\s+[A-Z]{3}\s+([0-9,.]+)",
        "insurance_value": r"\bInsurance\s+[A-Z]{3}\s+([0-9,.]+)",
        "cif_value": r"\bCIF Value\s+[A-Z]{3}\s+([0-9,.]+)",
    },
}
# document type -> (pattern of the totals line, group of the packages, group of the gross weight)
TOTALS_PATTERNS = {
    "bill_of_lading": (r"\bTOTAL:.*?(\d[\d,]*)\s+(?:CTNS|CARTONS|PACKAGES).*?([0-9,.]+)\s*KGS", 1, 2),
    "packing_list": (r"\bTOTAL\s*\(.+?\)\s+(\d[\d,]*)\s+(?:CARTONS|CTNS|PACKAGES).*?([0-9,.]+)\s+([0-9,.]+)\s+[0-9,.]+", 1, 3),
}
HS_LABEL = "HS CODE"
MONEY_TEXT_FIELDS = ["fob_value", "freight_value", "insurance_value", "cif_value"]
EVIDENCE_NUMBER_FIELDS = ["gross_weight", "cif_value", "fob_value", "freight_value", "insurance_value", "total_packages"]
# Words in a file name that tell the document type; the first group that occurs decides.
NAME_WORDS = [("bill_of_lading", "bl|bill|lading|konosemen"), ("packing_list", "pl|packing|packinglist")]


def _group(text: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    return once(F.regexp_extract(text, f"(?{flags}){pattern}", group), lambda found: F.nullif(found, F.lit("")))


def _tidy(c: Column) -> Column:
    return once(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ ,]+|[ ,]+$", ""), lambda tidy: F.nullif(tidy, F.lit("")))


def general_fields(text: Column) -> dict[str, Column]:
    """Typed values of the general label patterns."""
    found = {f: F.coalesce(*[_group(text, p) for p in patterns]) for f, patterns in GENERAL_PATTERNS.items()}
    found = {f: F.regexp_replace(c, r"^[ :\t\r\n]+|[ :\t\r\n]+$", "") for f, c in found.items()}
    return {
        "importer_npwp": F.regexp_replace(found["importer_npwp"], r"\s+", " "),
        "total_packages": found["total_packages"].try_cast("bigint"),
        "gross_weight": locale_float(found["gross_weight"]),
        "cif_value": locale_float(found["cif_value"]),
        "currency": F.left(F.upper(found["currency"]), F.lit(3)),
        "importer_name": F.trim(F.regexp_replace(found["importer_name"], r"\s+", " ")),
    }


def fallback_fields(text: Column) -> dict[str, Column]:
    """Values of the short fallback patterns, read as one more engine."""
    found = {f: _group(text, p, g) for f, (p, g) in FALLBACK_PATTERNS.items()}
    return {
        "importer_npwp": found["importer_npwp"],
        "total_packages": found["total_packages"].try_cast("bigint"),
        "gross_weight": as_number(found["gross_weight"]),
        "currency": F.upper(found["currency"]),
        "cif_value": as_number(found["cif_value"]),
    }


def hs_near_label(text: Column) -> Column:
    """The first eight digits anywhere after a label, else the first six; nothing without the label."""
    at = F.instr(F.upper(text), HS_LABEL)
    reach = F.substr(text, at)
    code = F.coalesce(_group(reach, r"\b(\d{8})\b"), _group(reach, r"\b(\d{6})\b"))
    return F.when(at > 0, code)


def container_list(text: Column) -> Column:
    """Distinct container numbers in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z]{4}\d{7})\b")))


def document_fields(text: Column, doc_type: Column) -> dict[str, Column]:
    """Values of the label patterns of a digital document, as text, by document type."""
    out: dict[str, Column] = {f: _tidy(_group(text, p, 1, "im")) for f, p in SHARED_PATTERNS.items()}
    out["container_numbers"] = F.nullif(F.array_join(container_list(text), ", "), F.lit(""))
    out["hs_code"] = hs_near_label(text)
    per_field: dict[str, Column] = {}
    for kind, patterns in TYPED_PATTERNS.items():
        for field, pattern in patterns.items():
            value = _tidy(_group(text, pattern, 1, "im"))
            if field in MONEY_TEXT_FIELDS:
                value = once(value, as_number).cast("string")
            per_field[field] = F.when(doc_type == kind, value) if field not in per_field else per_field[field].when(doc_type == kind, value)
    for kind, (pattern, packages, weight) in TOTALS_PATTERNS.items():
        pair = {
            "total_packages": once(_group(text, pattern, packages, "is"), as_number).try_cast("bigint").cast("string"),
            "gross_weight": once(_group(text, pattern, weight, "is"), as_number).cast("string"),
        }
        for field, value in pair.items():
            per_field[field] = F.when(doc_type == kind, value) if field not in per_field else per_field[field].when(doc_type == kind, value)
    return {**out, **per_field}


def as_observations(df: DataFrame, keys: list[str], fields: dict[str, Column], engine: str, confidence: Column | float) -> DataFrame:
    """Extracted columns as observation rows; fields without a value give no row."""
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), c.cast("string").alias("value")) for f, c in fields.items()])
    return (
        df.select(*keys, F.lit(engine).alias("engine"), F.inline(cells), conf.alias("confidence"))
        .where("value is not null and value <> ''")
    )


def infer_doc_type(name: Column) -> Column:
    chain = None
    for kind, words in NAME_WORDS:
        test = F.lower(name).rlike(words)
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    return chain.otherwise("invoice")


def json_from_text(text: Column) -> Column:
    """Flat JSON object inside model output as a map; think tags and fences removed, unreadable gives an empty map."""
    bare = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    empty = F.create_map().cast("map<string,string>")

    def parse(c: Column) -> Column:
        return F.from_json(F.nullif(c, F.lit("")), "map<string,string>")

    fenced = parse(F.regexp_extract(bare, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1))
    return F.coalesce(fenced, parse(F.regexp_extract(bare, r"(?s)\{.*\}", 0)), empty)


def text_evidence(field: Column, value: Column, text: Column) -> Column:
    """Does the folded value occur in the folded text; numbers also by their digits alone."""
    whole = folded(text)
    folded_value = folded(value)
    number = digits(value)
    by_digits = field.isin(EVIDENCE_NUMBER_FIELDS) & (number != "") & F.contains(whole, number)
    return F.coalesce((folded_value != "") & (F.contains(whole, folded_value) | by_digits), F.lit(False))


def estimate_confidence(field: Column, value: Column, evidence: Column, digital: Column, layer_confidence: Column) -> Column:
    """Base by document kind, raised for text evidence, lowered for its absence and for a bad format."""
    base = F.when(digital, 0.88).otherwise(0.82)
    base = F.greatest(base, F.when(layer_confidence > 0, F.least(F.lit(0.96), layer_confidence * 0.94)).otherwise(F.lit(0.0)))
    score = base + F.when(evidence, 0.05).otherwise(-0.12) + F.when(field_format_valid(field, value), 0.0).otherwise(-0.25)
    bounded = F.greatest(F.lit(0.35), F.least(F.lit(0.99), score))
    return F.round(bounded.cast("decimal(18,8)"), 4).cast("double")


# --- text statistics ---------------------------------------------------------------------------------------

SPACES = r"[\s\p{Z}]+"  # Fixed value: characters that are not ink


def text_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACES, ""))


def layer_confidence(chars: Column, pages: Column, min_per_page: int = 80) -> Column:
    return F.when(F.round((chars / F.greatest(pages, F.lit(1))).cast("decimal(18,6)"), 2) >= min_per_page, 1.0).otherwise(0.0)


def aju_number(canonical: Column, *others: Column) -> Column:
    """18-digit declaration number: the canonical field when it is exactly one, else the first found in the others, else the raw field."""
    exact = F.when(F.trim(canonical).rlike(r"^\d{18}$"), F.trim(canonical))
    found = [F.nullif(F.regexp_extract(c, r"\d{18}", 0), F.lit("")) for c in (canonical, *others)]
    return F.coalesce(exact, *found, canonical, F.lit(""))


