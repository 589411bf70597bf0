"""Labels, weights and record types of the span-policy operators."""

from __future__ import annotations

from pyspark.sql import types as T

# They must be these for results to agree.
LABELS = (
    "PERSON_NAME",
    "ACCOUNT_HANDLE",
    "CONTACT",
    "ADDRESS_GEO",
    "OFFICIAL_ID",
    "FINANCIAL_ACCOUNT",
    "AUTH_SECRET",
    "DIGITAL_ID",
    "DEMOGRAPHIC_PROFILE",
    "HEALTH_MEDICAL",
    "TRANSACTION_ASSET",
)
CRITICAL_LABELS = ("OFFICIAL_ID", "FINANCIAL_ACCOUNT", "AUTH_SECRET", "DIGITAL_ID", "HEALTH_MEDICAL", "TRANSACTION_ASSET")
RISK_PRIORITY = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
RISK_MULTIPLIERS = {"CRITICAL": 2.4, "HIGH": 1.8, "MEDIUM": 1.35, "LOW": 1.0}
BAND_WEIGHTS = {"CRITICAL": 4.0, "HIGH": 3.0, "MEDIUM": 2.0, "LOW": 1.0}
OUTSIDE_WEIGHT = 0.15
CATEGORY_WEIGHTS = {
    "PERSON_NAME": 1.4,
    "ACCOUNT_HANDLE": 1.8,
    "CONTACT": 1.5,
    "ADDRESS_GEO": 1.4,
    "OFFICIAL_ID": 4.0,
    "FINANCIAL_ACCOUNT": 4.5,
    "AUTH_SECRET": 5.0,
    "DIGITAL_ID": 3.0,
    "DEMOGRAPHIC_PROFILE": 2.7,
    "HEALTH_MEDICAL": 6.5,
    "TRANSACTION_ASSET": 3.0,
}
CATEGORY_PRIORITY = {
    "AUTH_SECRET": 100,
    "FINANCIAL_ACCOUNT": 95,
    "OFFICIAL_ID": 92,
    "HEALTH_MEDICAL": 90,
    "CONTACT": 80,
    "DIGITAL_ID": 78,
    "TRANSACTION_ASSET": 72,
    "DEMOGRAPHIC_PROFILE": 65,
    "ACCOUNT_HANDLE": 60,
    "PERSON_NAME": 55,
    "ADDRESS_GEO": 50,
}
ANCHOR_THRESHOLDS = {
    "PERSON_NAME": 0.50,
    "ACCOUNT_HANDLE": 0.56,
    "CONTACT": 0.52,
    "ADDRESS_GEO": 0.54,
    "OFFICIAL_ID": 0.22,
    "FINANCIAL_ACCOUNT": 0.22,
    "AUTH_SECRET": 0.22,
    "DIGITAL_ID": 0.22,
    "DEMOGRAPHIC_PROFILE": 0.74,
    "HEALTH_MEDICAL": 0.20,
    "TRANSACTION_ASSET": 0.22,
}
# Fixed values as well: the characters trimmed, thresholds, quotas, label groups and patterns.
TRIM_CHARACTERS = " \t\n\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~，。；：、（）【】《》“”‘’「」『』"
COVERAGE, CRITICAL, FALSE_POSITIVES, TOLERANCE, WORST = 0.90, 1.0, 0.05, 2, 20
SPLIT_SEED, DEVELOPMENT, HELDOUT = 1337, 0.02, 0.02
EXPERTS = ("anchor", "coverage", "precision")
LONG_TEXT, FEW_SPANS, LOW_RATIO = 500, 2, 0.02
LABEL_BUCKETS = {
    "HEALTH_MEDICAL": "health",
    "AUTH_SECRET": "auth",
    "OFFICIAL_ID": "official",
    "FINANCIAL_ACCOUNT": "financial",
    "DIGITAL_ID": "digital",
    "CONTACT": "contact",
    "DEMOGRAPHIC_PROFILE": "demographic",
    "ADDRESS_GEO": "address",
    "PERSON_NAME": "person",
    "TRANSACTION_ASSET": "transaction",
}
COMMON_LABELS = ("PERSON_NAME", "CONTACT", "ADDRESS_GEO", "OFFICIAL_ID", "HEALTH_MEDICAL")
NUMBER_LABELS = ("OFFICIAL_ID", "FINANCIAL_ACCOUNT", "AUTH_SECRET", "TRANSACTION_ASSET", "CONTACT")
ENTITY_LABELS = ("PERSON_NAME", "ACCOUNT_HANDLE", "ADDRESS_GEO")
DATE = r"\b(?:19|20)\d{2}[-/](?:0?[1-9]|1[0-2])[-/](?:0?[1-9]|[12]\d|3[01])\b|\b(?:0?[1-9]|1[0-2])[-/](?:0?[1-9]|[12]\d|3[01])[-/](?:19|20)?\d{2}\b"
NUMERIC = r"\b(?:\d[\d\- ]{5,}\d)\b"
GEOGRAPHIC = r"\b(?:street|st\.?|road|rd\.?|avenue|ave\.?|boulevard|blvd\.?|city|county|state|province|zip|postal|district|north|south|east|west)\b"
AMBIGUOUS = r"\b(?:university|bank|hospital|inc\.?|corp\.?|company|agency|department|team|school|office|committee)\b"

# Fixed values.
#: Curricula: quotas in priority order; the last, filler, is the size aimed at.
CURRICULA = {
    "shared_initialization": {"health": 18000, "transaction": 3000, "auth": 25000, "financial": 40000, "official": 55000, "digital": 35000, "demographic": 80000, "critical_risk": 90000, "long_text": 60000, "no_pii": 30000, "common": 150000, "filler": 300000},
    "shared_continuation": {"health": 22434, "transaction": 3143, "auth": 55000, "financial": 110000, "official": 160000, "digital": 90000, "critical_risk": 360000, "demographic": 220000, "long_text": 160000, "no_pii": 90000, "common": 420000, "filler": 800000},
    "coverage_expert": {"demographic": 90000, "address": 70000, "person": 70000, "contact": 80000, "official": 90000, "health": 50000, "auth": 55000, "financial": 70000, "digital": 55000, "transaction": 25000, "critical_risk": 120000, "high_risk": 150000, "no_pii": 60000, "low_density": 120000, "long_text": 90000, "common": 220000, "filler": 500000},
    "precision_expert": {"hard_negative": 130000, "date_negative": 50000, "numeric_negative": 60000, "geographic_negative": 50000, "ambiguous_negative": 40000, "no_pii": 100000, "low_density": 120000, "long_text": 70000, "critical_risk": 45000, "high_risk": 60000, "official": 25000, "health": 20000, "auth": 20000, "contact": 25000, "common": 80000, "filler": 300000},
    "anchor_repair": {"critical_risk": 75000, "health": 25000, "auth": 25000, "financial": 35000, "official": 40000, "digital": 30000, "high_risk": 80000, "hard_negative": 70000, "no_pii": 55000, "low_density": 60000, "long_text": 45000, "common": 90000, "filler": 200000},
}

#: Tag numbers: O, then B and I of each label.
TAGS = ("O", *(f"{p}-{label}" for label in LABELS for p in ("B", "I")))

ANNOTATION = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("risk_band", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("pcr_weight", T.DoubleType()),
        T.StructField("pcr_in_scope", T.BooleanType()),
        T.StructField("critical_for_pcr", T.BooleanType()),
        T.StructField("fine_labels", T.ArrayType(T.StringType())),
    ]
)
SAMPLE = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("pii_annotations", T.ArrayType(ANNOTATION))])
SPAN = "struct<start:int,end:int,label:string,weight:double,in_scope:boolean,critical:boolean>"
SCORED = "array<struct<start:int,end:int,label:string,score:double>>"
PREDICTION = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("pred_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])))])
