"""Fixed values of the event contract: names, codes, limits and Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: the contract's names, codes and limits
PREFIX = "com.careerpage.career."
EVENT_TYPES = [PREFIX + t for t in (
    "job-viewed", "job-wishlisted", "application-started", "application-step-completed", "application-draft-saved",
    "application-submitted", "application-abandoned", "user-registered", "user-logged-in",
)]
CONTEXT_ATTRIBUTES = [
    "specversion", "id", "source", "type", "subject", "time", "dataschema", "datacontenttype", "keyversion",
    "sequence", "sourcechannel", "referrertype", "completionmethod", "partitionkey",
]
CHANNELS = ["WEB_APP", "MOBILE_APP", "THIRD_PARTY_SERVICE"]
REFERRERS = ["SEARCH", "RECOMMENDATION", "THIRD_PARTY_WEBHOOK", "DIRECT"]
COMPLETION_METHODS = ["MANUAL", "RESUME_AUTOFILL", "HYBRID"]
EXPERIENCE = ["FRESHER", "EXPERIENCED"]
KNOWN_CODES = ["SCHEMA", "UNKNOWN_ATTRIBUTE", "OVERSIZED", "MIXED_TENANT", "BAD_SOURCE", "BAD_TIME", "BAD_ID", "RAW_SUBJECT", "DUPLICATE_ID"]
CANDIDATE_KEYS = ["user_id", "email", "phone", "alternate_phone", "name", "gender", "experience_status", "years_of_experience", "education_degree", "education_branch"]
PAYLOAD_KEYS = ["job_id", "session_id", "step_number", "step_name", "action", "completion_method", "time_spent_on_step_ms", "total_application_duration_ms", "recommended_job_ids", "client_metadata"]
PII_FIELDS = ["email", "phone", "alternate_phone", "name", "gender"]
SOURCE_RE = "^/careers/([A-Za-z0-9_-]{1,64})$"
TIME_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
MAX_BODY_BYTES, MAX_EVENTS, MAX_INGRESS_BYTES, MAX_EVENT_BYTES = 4 << 20, 500, 48 << 10, 64 << 10
UNKNOWN_SOURCE = "/careers/_unknown"
DLQ_TYPE = PREFIX + "ingestion-error"
DLQ_SCHEMA = "https://schema.careerpage.example/dlq/1.0"
TOPIC_RAW, TOPIC_DLQ = "career.events.raw", "career.events.dlq"
LABEL_CAP, UNSET, OTHER = 64, "__unset__", "__other__"

_s, _l = T.StringType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CANDIDATE = _struct(**{k: T.DoubleType() if k == "years_of_experience" else _s for k in CANDIDATE_KEYS})
PAYLOAD = _struct(**{k: _l if k in ("step_number", "time_spent_on_step_ms", "total_application_duration_ms") else T.ArrayType(_s) if k == "recommended_job_ids" else T.VariantType() if k == "client_metadata" else _s for k in PAYLOAD_KEYS})
INGRESS_EVENT = _struct(**{k: _l if k == "keyversion" else _s for k in CONTEXT_ATTRIBUTES}, data=_struct(candidate=CANDIDATE, event_payload=PAYLOAD))
# the candidate of a published event: a pseudonym and sealed fields in place of plain ones
SEALED_CANDIDATE = _struct(**{k: T.DoubleType() if k == "years_of_experience" else _s for k in ["user_id_pseudo", "email_hmac", *[f"{f}_enc" for f in PII_FIELDS], "experience_status", "years_of_experience", "education_degree", "education_branch"]})
PUBLISHED_EVENT = _struct(**{k: _l if k == "keyversion" else _s for k in CONTEXT_ATTRIBUTES}, data=_struct(candidate=SEALED_CANDIDATE, event_payload=PAYLOAD))
LEDGER = _struct(id=_s, source=_s, type=_s, tenant=_s, user_ref=_s, seq=_l)


def drift(found: T.StructType, declared: T.StructType) -> list[str]:
    """Names of the columns that differ between a schema and its declaration, missing and extra ones included."""
    a, b = ({f.name: f.dataType.jsonValue() for f in s} for s in (found, declared))
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))
