"""Contacts from a stream of documents: each address once per watermark period."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.contacts import scan_emails


def first_seen(stream: DataFrame, time: str, text: str, delay: str = "1 day") -> DataFrame:
    """Addresses of a stream with ``time`` and ``text``, without those seen within ``delay``."""
    found = scan_emails(stream.withWatermark(time, delay), text, time)
    return found.dropDuplicatesWithinWatermark(["email"])
