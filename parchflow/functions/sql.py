"""Functions under names of SQL; an addition."""

from __future__ import annotations

import unicodedata

from pyspark.sql import SparkSession

from parchflow.functions.html import markdown_to_html
from parchflow.functions.lines import join_broken
from parchflow.runtime import string_udf


def register(spark: SparkSession) -> list[str]:
    """Registers clean_text, strip_text, dehyphenate, nfc and markdown_to_html for this session."""
    for name, fn in (("nfc", lambda t: unicodedata.normalize("NFC", t or "")), ("dehyphenate", join_broken), ("markdown_to_html", markdown_to_html)):
        spark.udf.register(name, string_udf(fn))
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION strip_text(t STRING) RETURNS STRING RETURN regexp_replace(coalesce(t, ''), '(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+\\z', '')""")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION clean_text(t STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(coalesce(t, ''), '[\\x00\\uFFFD\\uFFFC[\\p{Cc}&&[^\\n\\r\\t]]\\p{Cf}]', ''), '\\p{Zs}', ' ')""")
    return ["nfc", "dehyphenate", "markdown_to_html", "strip_text", "clean_text"]
