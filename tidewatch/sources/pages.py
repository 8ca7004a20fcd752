"""Fields of stored web pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    """Text of the title element, null without one."""
    return F.nullif(F.trim(F.regexp_extract(html, r"<title>([^<]*)</title>", 1)), F.lit(""))


def url_parts(url: Column) -> list[Column]:
    part = lambda p: F.try_parse_url(url, F.lit(p))
    return [part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), F.nullif(part("PATH"), F.lit("")).alias("path"), part("QUERY").alias("query")]
