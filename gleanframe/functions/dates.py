"""Days from the dates that cameras write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LENGTH = {"year": 4, "month": 7, "day": 10}
_FORM = "\\A([0-9]{4}):([0-9]{2}):([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})\\z"


#: Why a date has no folder.
MISSING, OTHER_FORM, NO_DATE = "missing_datetime_original", "invalid_datetime_original_format", "invalid_datetime_original_value"
NO_METADATA, OTHER_EXIF, OTHER_TYPE = "metadata_unavailable", "invalid_exif_type", "invalid_datetime_original_type"


def date_bucket(text: Column, granularity: str) -> Column:
    """The year, month or day of ``YYYY:MM:DD HH:MM:SS``, by the camera's calendar; NULL where ``skip_reason`` isn't."""
    return F.when(skip_reason(text).isNull(), F.substring(F.replace(F.substring(text, 1, 10), F.lit(":"), F.lit("-")), 1, _LENGTH[granularity]))


def skip_reason(text: Column) -> Column:
    """Why a date has no bucket: missing, of another form, or no date of the calendar."""
    real = F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")).isNotNull() & (F.substring(text, 1, 4) != "0000")
    return (
        F.when(text.isNull() | (text == ""), MISSING)
        .when(~text.rlike(_FORM), OTHER_FORM)
        .when(~real, NO_DATE)
    )


def saved_date(state: Column, metadata: Column) -> tuple[Column, Column]:
    """(date text, why there is no folder) of an item's state and metadata document. A document that can't be read has no EXIF."""
    document = F.try_parse_json(metadata)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    exif, taken = kind("$.exif"), kind("$.exif.datetime_original")
    text = F.try_variant_get(document, "$.exif.datetime_original", "string")
    absent = lambda k: F.coalesce(k, F.lit("VOID")) == "VOID"
    reason = (
        F.when(~F.coalesce(state == "available", F.lit(False)), NO_METADATA)
        .when(~absent(exif) & ~exif.startswith("OBJECT"), OTHER_EXIF)
        .when(absent(taken), MISSING)
        .when(taken != "STRING", OTHER_TYPE)
        .otherwise(skip_reason(text))
    )
    return text, reason
