"""Text rules for names and settings, as patterns usable on columns and on single values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What names and settings may look like (full matches, valid in Java and Python).
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{0,127}"
PATH_SEGMENT = r"[A-Za-z0-9_\-]{1,128}"
ROW_TAG = r"[A-Za-z_][A-Za-z0-9_.\-:]{0,127}"
JOB_NAME = r"[A-Za-z0-9][A-Za-z0-9 _.\-]{0,99}"
TIME_OF_DAY = r"([01][0-9]|2[0-3]):[0-5][0-9]"
DELIMITER = r'[^"\\\r\n\x00{}]{1,4}'
SIMPLE_TEXT = r"[A-Za-z0-9 _.\-/+:@#]{0,64}"
PATH_PREFIXES = ("/", "s3://", "s3a://", "abfss://", "gs://", "dbfs:/")
PATH_FORBIDDEN = r"[\x00-\x1f\x7f\"'`\\${}]"
MAX_PATH = 2048
MAX_FILE_NAME = 255
RESERVED_COLUMNS = ("_ingested_at", "_source_file", "_batch_id")

_PATTERNS = {
    "identifier": IDENTIFIER,
    "path_segment": PATH_SEGMENT,
    "row_tag": ROW_TAG,
    "job_name": JOB_NAME,
    "time_of_day": TIME_OF_DAY,
    "delimiter": DELIMITER,
    "simple_text": SIMPLE_TEXT,
}


def _whole(pattern: str) -> str:
    return r"\A(?:" + pattern + r")\z"


def allowed(rule: str, text: Column) -> Column:
    """Whether a text column satisfies a rule; null never does."""
    if rule == "path":
        ok = (
            F.length(text).between(1, MAX_PATH)
            & text.rlike("^(?:" + "|".join(re.escape(p) for p in PATH_PREFIXES) + ")")
            & ~text.rlike(PATH_FORBIDDEN)
            & ~text.rlike(r"(?:\A|/)\.\.(?:/|\z)")
        )
    elif rule == "file_name":
        ok = (
            F.length(text).between(1, MAX_FILE_NAME)
            & ~text.contains("/")
            & ~text.rlike(PATH_FORBIDDEN)
            & ~text.isin(".", "..")
        )
    else:
        ok = text.rlike(_whole(_PATTERNS[rule]))
    return F.coalesce(ok, F.lit(False))


def is_allowed(rule: str, text: str | None) -> bool:
    """The same rules for a single setting on the driver."""
    if not isinstance(text, str):
        return False
    if rule == "path":
        return (
            1 <= len(text) <= MAX_PATH
            and text.startswith(PATH_PREFIXES)
            and re.search(PATH_FORBIDDEN, text) is None
            and ".." not in text.split("/")
        )
    if rule == "file_name":
        return (
            1 <= len(text) <= MAX_FILE_NAME
            and "/" not in text
            and re.search(PATH_FORBIDDEN, text) is None
            and text not in (".", "..")
        )
    return re.fullmatch(_PATTERNS[rule], text) is not None


def require(rule: str, text: str, what: str) -> str:
    if not is_allowed(rule, text):
        raise ValueError(f"{what} {text!r} breaks the {rule} rule")
    return text
