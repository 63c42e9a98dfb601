"""The training-data queries and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taplight.llm import warc
from taplight.llm.decontaminate import op5_decontaminate
from taplight.llm.language import op11_language
from taplight.llm.lm_scoring import op2_lm_scoring
from taplight.llm.matroska import op6_media_columns
from taplight.llm.near_dedup import op1_near_dedup
from taplight.llm.periodic import op13_runs
from taplight.llm.piece_codec import op8_piece_codec
from taplight.llm.quality import op4_quality
from taplight.llm.secret_scan import op3_secret_scan
from taplight.llm.sst import op7_token_shards
from taplight.llm.substring import op10_substring_dedup
from taplight.llm.warc import op9_warc
from taplight.llm.whitening import op12_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op2_lm_scoring": op2_lm_scoring,
        "op4_quality": op4_quality,
        "op5_decontaminate": op5_decontaminate,
        "op1_near_dedup": op1_near_dedup,
        "op10_substring_dedup": op10_substring_dedup,
        "op3_secret_scan": op3_secret_scan,
        "op9_warc": op9_warc,
        "op7_token_shards": op7_token_shards,
        "op8_piece_codec": op8_piece_codec,
        "op6_media_columns": op6_media_columns,
        "op11_language": op11_language,
        "op12_whitening": op12_whitening,
        "op13_runs": op13_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_warc": warc.OP9_SQL,
    }
