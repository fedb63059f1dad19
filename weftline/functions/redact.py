"""Secrets kept out of logs: in values by pattern, in fields by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names whose values never show, and patterns with what replaces them.
HIDDEN = "[REDACTED]"
SENSITIVE = ("api_key", "authorization", "context", "cookie", "database_url", "openai_api_key", "password", "prompt", "raw_text", "secret", "source_text")
SENSITIVE_ENDS = ("_api_key", "_password", "_secret")
PATTERNS = (
    (r"(?i)\bBearer\s+[^\s,;]+", "Bearer [REDACTED]"),
    (r"(?i)\bsk-[A-Za-z0-9_-]{8,}", "[REDACTED]"),
    (r"(?i)(postgres(?:ql)?(?:\+[a-z0-9_]+)?://[^:\s/@]+:)[^@\s]+@", "$1[REDACTED]@"),
    (r"(?i)\b(api[_-]?key|password|secret|access_token)=([^&\s]+)", "$1=[REDACTED]"),
)


def redact(text: Column) -> Column:
    for pattern, instead in PATTERNS:
        text = F.regexp_replace(text, pattern, instead)
    return text


def is_sensitive(field: Column) -> Column:
    name = F.lower(F.trim(field))
    return name.isin(*SENSITIVE) | name.rlike("(?:" + "|".join(SENSITIVE_ENDS) + ")$")


def redact_map(fields: Column) -> Column:
    """A map of log fields with sensitive ones hidden and the others searched."""
    return F.transform_values(fields, lambda k, v: F.when(is_sensitive(k), F.lit(HIDDEN)).otherwise(redact(v)))


def redact_list(values: Column) -> Column:
    return F.transform(values, redact)


def hidden(field: str) -> bool:
    """Whether a field of this name never shows."""
    name = field.strip().lower()
    return name in SENSITIVE or name.endswith(SENSITIVE_ENDS)


def sanitized(value: Column, kind: T.DataType, field: str = "") -> Column:
    """A value of any type without secrets, for JSON: keys sorted at every depth.

    Numbers and booleans stay what they are, structs, maps and arrays are gone
    into, anything else is searched as text.
    """
    if hidden(field):
        return F.lit(HIDDEN)
    if isinstance(kind, T.StructType):
        parts = [sanitized(value[f.name], f.dataType, f.name).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sanitized(x, kind.elementType))
    if isinstance(kind, T.MapType):
        text = isinstance(kind.valueType, T.StringType)
        entries = F.array_sort(F.map_entries(F.transform_keys(value, lambda k, _: k.cast("string"))))

        def entry(e: Column) -> Column:
            clean = sanitized(e["value"], kind.valueType)
            # a map has one type: a hidden value that is no text becomes null
            secret = F.lit(HIDDEN) if text else F.lit(None).cast(kind.valueType)
            return F.struct(e["key"].alias("key"), F.when(is_sensitive(e["key"]), secret).otherwise(clean).alias("value"))

        return F.map_from_entries(F.transform(entries, entry))
    if isinstance(kind, (T.NumericType, T.BooleanType, T.NullType)) and not isinstance(kind, T.DecimalType):
        return value
    return redact(value.cast("string"))
