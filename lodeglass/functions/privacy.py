"""Plain secret patterns for health reports and events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of secret-like values, and what replaces them.
SECRET_PATTERNS = (r"sk-[A-Za-z0-9]{20,}", r"ghp_[A-Za-z0-9]{20,}", r"AIza[0-9A-Za-z\-_]{20,}", r"AKIA[0-9A-Z]{16}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
REDACTED_SECRET = "[REDACTED:secret]"
REDACTED_SOURCE = "[REDACTED:source-text]"
#: Keys of event data whose values are source text.
SOURCE_KEYS = ("content", "preview", "source", "text")


def secret_like(col: Column | str) -> Column:
    """Whether a text holds something that looks like a secret; null holds nothing."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike("|".join(SECRET_PATTERNS)), F.lit(False))


def redact_secrets(col: Column | str) -> Column:
    out = F.col(col) if isinstance(col, str) else col
    for p in SECRET_PATTERNS:
        out = F.regexp_replace(out, p, REDACTED_SECRET)
    return out


def redact_map(col: Column | str) -> Column:
    """All values of a map with secrets replaced."""
    return F.transform_values(col, lambda k, v: redact_secrets(v))


def sanitize_event_data(col: Column | str, redact_source_text: bool = True) -> Column:
    """Event data without secrets and, if asked for, without source text under the keys that hold it."""
    source = lambda k: F.lower(F.element_at(F.split(k, r"\."), -1)).isin(*SOURCE_KEYS)
    return F.transform_values(col, lambda k, v: F.when(source(k) & F.lit(redact_source_text) & v.isNotNull(), F.lit(REDACTED_SOURCE)).otherwise(redact_secrets(v)))
