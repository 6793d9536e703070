"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP2_SQL, op2_chat_formatting
from .decontaminate import op1_decontamination
from .images import op5_image_copies
from .language import op6_language_id
from .mixing import OP8_SQL, op8_mixing
from .near_dup import op10_near_dup
from .secrets import BASE_SQL, op7_secret_scan, secret_base_spans
from .toxicity import op4_toxicity
from .url_filter import OP9_SQL, op9_url_filter
from .warc import OP3_SQL, op3_warc_revisits


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_chat_formatting, op3_warc_revisits, op4_toxicity, op5_image_copies, op6_language_id, op7_secret_scan, op8_mixing, op9_url_filter, op10_near_dup, secret_base_spans)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": OP2_SQL, "op3_warc_revisits": OP3_SQL, "op8_mixing": OP8_SQL, "op9_url_filter": OP9_SQL, "secret_base_spans": BASE_SQL}
