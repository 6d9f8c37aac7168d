"""Names, word lists, thresholds and lookup tables the results depend on."""

from __future__ import annotations

# --- Fixed values: vocabulary -------------------------------------------------------------------
DOC_TYPES = ["bill_of_lading", "packing_list", "invoice"]
USER_TIERS = ["enterprise", "sme"]
BATCH_STATUSES = [
    "uploaded", "preprocessing", "ocr_running", "ocr_complete", "extracting", "extracted",
    "validating", "validated", "review_ready", "reviewing", "approved", "submitting",
    "submitted", "accepted", "rejected", "error",
]
PROCESSING_STATUSES = ["uploaded", "preprocessing", "ocr_running", "extracting", "validating", "processing"]
TERMINAL_STATUSES = ["accepted", "rejected", "failed"]
END_EVENTS = ["pipeline_complete", "review_ready"]

# The batch life cycle, each state with the states that may follow it.
LIFE_CYCLE = {
    "uploaded": ["preprocessing"],
    "preprocessing": ["ocr_running"],
    "ocr_running": ["ocr_complete"],
    "ocr_complete": ["vessel_validating"],
    "vessel_validating": ["validating"],
    "validating": ["validated"],
    "validated": ["review_ready"],
    "review_ready": ["reviewing"],
    "reviewing": ["approved"],
    "approved": ["submitting"],
    "submitting": ["insw_check"],
    "insw_check": ["submitted"],
    "submitted": ["processing"],
    "processing": ["accepted", "rejected"],
    "rejected": ["reviewing"],
    "accepted": [],
}

# --- Fixed values: engines ----------------------------------------------------------------------
ENGINES = ["agent_a", "agent_b", "agent_c", "agent_d"]
ENGINE_WEIGHTS = {
    "pdf_text": 1.00,
    "azure-di": 0.92,
    "azure-di-fallback": 0.90,
    "paddleocr": 0.84,
    "gemini": 0.82,
    "rule_based": 0.70,
}
UNKNOWN_ENGINE_WEIGHT = 0.75
DEFAULT_CONFIDENCE = 0.75

# --- Fixed values: fields expected per document type --------------------------------------------
COMMON_FIELDS = [
    "vessel_name", "voyage_number", "bl_number", "port_loading_code", "port_discharge_code",
    "gross_weight", "net_weight", "total_packages", "container_number", "bl_date",
]
INVOICE_FIELDS = [
    "invoice_number", "invoice_date", "seller_name", "buyer_name", "buyer_npwp", "npwp", "nib",
    "currency", "fob_value", "freight", "insurance", "cif_value",
]
PACKING_FIELDS = ["pl_number", "pl_date", "total_gross_weight", "total_net_weight"]
GOODS_FIELDS = ["hs_code", "goods_description"]
EXPECTED_FIELDS = {
    "bill_of_lading": COMMON_FIELDS,
    "invoice": COMMON_FIELDS + INVOICE_FIELDS + GOODS_FIELDS,
    "packing_list": COMMON_FIELDS + PACKING_FIELDS + GOODS_FIELDS,
}
REQUIRED_FIELDS = ["importer_name", "importer_npwp", "total_packages", "gross_weight", "cif_value", "currency"]
CRITICAL_FIELDS = ["hs_code", "nib", "npwp", "cif_value"]

# --- Fixed values: alternative names of one quantity, canonical name first ------------------------
FIELD_ALIASES = {
    "bl_number": ["bl_number", "nomorBl"],
    "vessel_name": ["vessel_name", "namaKapal"],
    "voyage_number": ["voyage_number", "voyageNumber"],
    "port_loading_code": ["port_loading_code", "kodePelabuhanMuat", "port_of_loading"],
    "port_discharge_code": ["port_discharge_code", "kodePelabuhanBongkar", "port_of_discharge"],
    "bl_date": ["bl_date", "tglBl"],
    "arrival_date": ["arrival_date", "tglArrival", "eta"],
    "gross_weight": ["gross_weight", "beratKotor"],
    "net_weight": ["net_weight", "beratBersih"],
    "total_packages": ["total_packages", "jumlahKemasan"],
    "container_number": ["container_number", "container_numbers", "nomorContainer", "containerNumber"],
    "npwp": ["npwp", "importer_npwp", "nomorIdentitas", "buyer_npwp"],
    "nib": ["nib", "importer_nib", "nibEntitas"],
    "importer_name": ["buyer_name", "importer_name", "namaEntitas", "consignee_name"],
    "importer_address": ["buyer_address", "alamatEntitas"],
    "hs_code": ["hs_code", "posTarif"],
    "goods_description": ["goods_description", "uraianBarang", "description_of_goods"],
    "quantity": ["quantity", "jumlahSatuan"],
    "unit": ["unit", "satuanBarang"],
    "fob_value": ["fob_value", "nilaiTotalFob", "total_amount", "fob"],
    "cif_value": ["cif_value", "nilaiCif", "total_cif", "cif"],
    "freight": ["freight", "nilaiFreight", "freight_value"],
    "insurance": ["insurance", "nilaiAsuransi", "asuransi", "insurance_value"],
    "currency": ["currency", "valuta", "currency_code"],
}

# --- Fixed values: which normaliser serves which field --------------------------------------------
DATE_FIELDS = ["bl_date", "invoice_date", "eta", "etd", "tglBl", "tglPendaftaran", "tglArrival"]
CONTAINER_FIELDS = ["container_number", "containerNumber"]
HS_FIELDS = ["hs_code", "posTarif"]
WEIGHT_FIELDS = ["gross_weight", "net_weight", "beratKotor", "beratBersih"]
CURRENCY_FIELDS = ["currency"]
MONEY_FIELDS = ["cif_value", "fob_value", "invoice_total", "cif", "fob", "freight", "asuransi"]
NPWP_FIELDS = ["npwp", "nomorIdentitas"]
NIB_FIELDS = ["nib", "nibEntitas"]
VESSEL_FIELDS = ["vessel_name", "namaKapal"]
PORT_FIELDS = ["port_loading_code", "kodePelabuhanMuat", "port_discharge_code", "kodePelabuhanBongkar"]

# Date layouts in the order they are tried (Spark pattern letters).
DATE_LAYOUTS = [
    "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "MMMM d, yyyy", "d MMMM yyyy", "d MMM yyyy",
    "MMM d, yyyy", "yyyyMMdd", "d/M/yy", "M/d/yyyy",
]
ACCEPTED_DATE_LAYOUTS = ["d/M/yyyy", "d-M-yyyy", "MMMM d, yyyy", "d MMMM yyyy"]
# Carrier date shapes (regular expression, Spark layout).
CARRIER_DATE_LAYOUTS = [
    (r"\d{2}/[A-Z]{3}/\d{4}", "dd/MMM/yyyy"),
    (r"[A-Z]{3}-\d{2}-\d{4}", "MMM-dd-yyyy"),
    (r"\d{2}/\d{2}/\d{4}", "dd/MM/yyyy"),
    (r"\d{2}-\d{2}-\d{4}", "dd-MM-yyyy"),
    (r"[A-Z]{3}\.\d{2},\d{4}", "MMM.dd,yyyy"),
    (r"\d{2}\.\d{2}\.\d{4}", "dd.MM.yyyy"),
    (r"\d{2}-[A-Z]{3}-\d{4}", "dd-MMM-yyyy"),
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
]
VESSEL_PREFIXES = [r"NMV\s+", r"M/V\s+", r"MV\s+", r"S\.S\.\s+", r"SS\s+", r"MT\s+", r"M\.T\.\s+"]
# Kilograms per weight unit.
KILOGRAMS_PER_UNIT = {
    "KGS": 1.0, "KG": 1.0, "KGM": 1.0, "GRS": 1.0,
    "MTS": 1000.0, "MT": 1000.0, "T": 1000.0, "TONNE": 1000.0,
    "LBS": 0.453592, "LB": 0.453592,
}

# --- Fixed values: ports ----------------------------------------------------------------------------
# Port name as printed -> location code; the order decides which partial match wins.
PORT_NAMES = [
    ("TILBURY, ESSEX", "GBTIL"), ("TILBURY", "GBTIL"), ("NHAVA SHEVA", "INNSA"),
    ("JEBEL ALI", "AEJEA"), ("JEBEL ALI, U.A.E.", "AEJEA"), ("ODESSA", "UAODS"),
    ("ODESSA, UKRAINE", "UAODS"), ("GUANGZHOU PORT, CHINA", "CNGZH"), ("GUANGZHOU", "CNGZH"),
    ("ONNE PORT", "NGAPP"), ("HAMBURG", "DEHAM"), ("MUNDRA, INDIA", "INMUN"), ("MUNDRA", "INMUN"),
    ("HO CHI MINH CITY PORT, VIETNAM", "VNSGN"), ("HO CHI MINH", "VNSGN"),
    ("KUANTAN, MALAYSIA", "MYKUA"), ("KUANTAN", "MYKUA"), ("JAKARTA, INDONESIA", "IDJKT"),
    ("JAKARTA", "IDJKT"), ("SHEKOU, CHINA", "CNSHK"), ("SHEKOU", "CNSHK"),
    ("CIKARANG DRY PORT", "IDJBK"), ("CDP", "IDJBK"), ("IDJBK", "IDJBK"),
]
HOME_PORT_CODE = "IDJBK"
HOME_PORT_NAME = "Cikarang Dry Port"
DEFAULT_DISCHARGE_PORT = "IDJKT"

# --- Fixed values: restricted goods, tariff chapter -> permits ----------------------------------------
RESTRICTED_CHAPTERS = {
    "01": ["SNI_REQUIRED", "BPOM_REGISTRATION"],
    "04": ["BPOM_REGISTRATION"],
    "07": ["PHYTOSANITARY_CERTIFICATE", "KEMENTAN_APPROVAL"],
    "08": ["PHYTOSANITARY_CERTIFICATE"],
    "10": ["KEMENTAN_APPROVAL"],
    "21": ["BPOM_REGISTRATION"],
    "28": ["DANGEROUS_GOODS_PERMIT"],
    "30": ["BPOM_REGISTRATION", "HALAL_CERTIFICATE"],
    "61": ["SNI_REQUIRED"],
    "62": ["SNI_REQUIRED"],
    "84": ["SNI_REQUIRED"],
    "85": ["SNI_REQUIRED"],
    "93": ["POLRI_PERMIT"],
    "97": ["CITES_PERMIT"],
}
DANGEROUS_CHAPTER = "28"
WATCHED_VESSELS = ["SANCTIONED VESSEL", "BLOCKED SHIP"]

# --- Fixed values: customs error codes ----------------------------------------------------------------
# code -> (class, field it names)
ERROR_CODES = {
    "E001": ("OPERATOR_REQUIRED", "bl_number"),
    "E004": ("OPERATOR_REQUIRED", "hs_code"),
    "E007": ("AUTO_RECOVERABLE", "bl_date"),
    "E012": ("ADMIN_ESCALATION", "npwp"),
    "E015": ("OPERATOR_REQUIRED", "cif_value"),
    "E019": ("AUTO_RECOVERABLE", "country"),
    "E023": ("AUTO_RECOVERABLE", "port"),
    "E031": ("OPERATOR_REQUIRED", "nib"),
    "E099": ("ADMIN_ESCALATION", "company"),
}
# code -> class used by the service variant
SERVICE_ERROR_CODES = {
    "E001": "AUTO_RECOVERABLE", "E002": "AUTO_RECOVERABLE", "E003": "AUTO_RECOVERABLE",
    "E004": "AUTO_RECOVERABLE", "E005": "AUTO_RECOVERABLE", "E010": "AUTO_RECOVERABLE",
    "E101": "OPERATOR_REQUIRED", "E102": "OPERATOR_REQUIRED", "E103": "OPERATOR_REQUIRED",
    "E201": "OPERATOR_REQUIRED", "E202": "OPERATOR_REQUIRED",
}

# --- Fixed values: scoring ------------------------------------------------------------------------------
API_PILLARS = {"doc_quality": 0.20, "completeness": 0.25, "consistency": 0.30, "historical": 0.15, "hs_conf": 0.10}
HISTORICAL_DEFAULT = 0.80
GRADES = {
    "agents": [(85, "A"), (70, "B"), (55, "C"), (40, "D")],
    "api": [(90, "A"), (80, "B"), (70, "C"), (60, "D")],
    "spec": [(85, "A"), (70, "B"), (55, "C")],
}
LOWEST_GRADE = {"agents": "F", "api": "F", "spec": "D"}
RISK_LEVELS = {
    "agents": [(0.70, "HIGH"), (0.40, "MEDIUM"), (0.20, "LOW")],
    "api": [(0.60, "CRITICAL"), (0.35, "HIGH"), (0.15, "MEDIUM")],
    "spec": [(0.70, "CRITICAL"), (0.45, "HIGH"), (0.20, "MEDIUM")],
}
LOWEST_RISK = {"agents": "VERY_LOW", "api": "LOW", "spec": "LOW"}
AGENT_FEATURES = [
    "crs_score", "critical_validation_failures", "agent_disagreement_count", "hs_code_confidence",
    "vessel_validation_critical", "missing_required_fields_count", "document_quality", "agent_agreement_rate",
]
API_FEATURES = [
    "doc_quality_score", "completeness_score", "consistency_score", "historical_rate", "hs_confidence",
    "cif_value_usd", "package_count", "gross_weight_kg",
]
MIN_SUBMIT_SCORE = 55.0
MIN_AUTO_SCORE = 70.0
REVIEW_PROBABILITY = 0.35
MAX_ATTEMPTS = 5
MONTHLY_PAGE_LIMIT = 5000
DRIFT_DAYS = 30
DRIFT_MIN_CORRECTIONS = 50
RETRAIN_MIN_SAMPLES = 100
MODEL_MIN_ROWS = 500

# --- Fixed values: evaluation -----------------------------------------------------------------------------
EVAL_FIELD_WEIGHTS = {
    "nomorBl": 3.0, "tglBl": 2.0, "pelabuhan_muat": 1.5, "pelabuhan_bongkar": 1.5, "container_no": 2.0,
    "beratKotor": 2.5, "hs_code": 3.0, "namaKapal": 1.5, "voyageNumber": 1.0,
}
# metric -> (target, allowed change)
EVAL_GATES = {
    "field_extraction_accuracy_digital": (0.95, -0.05),
    "field_extraction_accuracy_scanned": (0.85, -0.05),
    "hs_recommendation_top1_accuracy": (0.75, -0.05),
    "cross_doc_validation_recall": (0.95, -0.05),
    "processing_time_p95_cpu_seconds": (45.0, 10.0),
    "critical_fields_accuracy": (0.92, -0.03),
    "agent_disagreement_flagging_rate": (0.90, -0.05),
    "vessel_validation_accuracy": (0.88, -0.05),
}

# --- Fixed values: carriers ---------------------------------------------------------------------------------
CARRIERS = {
    "HLCU": {"name": "Hapag-Lloyd", "route": "FAST_PATH", "bl_pattern": r"^(HLCU|HLBV)\d{9}$",
             "bl_prefixes": ["HLCU", "HLBV"], "strip_prefixes": ["M/V ", "MV ", "S.S. "], "strip_suffixes": [],
             "vessels": ["RIO DE LA PLATA", "CAP VERDE"]},
    "MAEU": {"name": "Maersk", "route": "FAST_PATH", "bl_pattern": r"^\d{9}$",
             "bl_prefixes": ["MAEU"], "strip_prefixes": ["NMV ", "MV ", "M.V. "], "strip_suffixes": [],
             "vessels": ["NMV MAERSK COPENHAGEN"]},
    "EGLV": {"name": "Evergreen", "route": "STANDARD", "bl_pattern": r"^(EGHU|EITU|EISU)\d{9}$",
             "bl_prefixes": ["EGLV", "EGHU", "EITU", "EISU"], "strip_prefixes": [], "strip_suffixes": [" V."],
             "vessels": ["CAPE NORVIEGA", "HANJIN ROTTERDAM", "KMTC DUBAI"]},
    "CSLU": {"name": "Cordelia", "route": "STANDARD", "bl_pattern": r"^(CSLU|CSOU)\d{9}$",
             "bl_prefixes": ["CSLU", "CSOU", "CSX"], "strip_prefixes": [], "strip_suffixes": [],
             "vessels": ["GFS GISELLE"]},
    "CMDU": {"name": "CMA CGM", "route": "STANDARD", "bl_pattern": r"^(CMDU|APLU)\d{9}$",
             "bl_prefixes": ["CMDU", "APLU"], "strip_prefixes": [], "strip_suffixes": [], "vessels": []},
}

# Port codes in common use
KNOWN_LOCODES = [
    "IDJKT", "IDJBK", "IDTPP", "IDSBY", "IDBTM", "IDPLM", "IDMKQ", "IDDJJ", "IDAMT",
    "CNSHA", "CNSZX", "CNNGB", "CNGZH", "CNSHK", "CNQIN", "SGSIN", "MYPEN", "MYPKG", "MYKUA", "INNSA", "INMUN", "INPAV",
    "AEJEA", "AEAUH", "DEHAM", "GBTIL", "NLRTM", "USNYC", "USLAX", "USSEA", "JPOSA", "JPTYO", "KRPUS", "KRSEL", "VNSGN", "VNHPH", "THBKK", "THLTB",
]

# Texts of the vessel issues; names in braces are columns
VESSEL_MESSAGES = {
    "no_name": "No vessel name to check.",
    "not_seen": "Vessel '{vessel_name}' not found in AIS database. Manual verification recommended.",
    "eta": "ETA discrepancy: AIS reports vessel arrival {eta_day} but B/L date is {bl_date}. Difference exceeds 72 hours.",
    "no_lineup": "Vessel '{vessel_name}' not found in port lineup for '{port}'. This is informational only.",
    "watched": "Vessel '{vessel_name}' appears on a sanctions watchlist.",
}
HS_SEARCH_CONFIDENCE = 0.75  # codes below go to the tariff search
