"""The operators' queries over the whole of their tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm.infill import OP11_SQL, op11
from treeloom.llm.langid import op6
from treeloom.llm.licences import op7
from treeloom.llm.linededup import OP3_SQL, op3
from treeloom.llm.media import op8
from treeloom.llm.mixing import OP9_SQL, op9
from treeloom.llm.neardup import op4
from treeloom.llm.packing import op5
from treeloom.llm.quality import op10
from treeloom.llm.simhash import op12
from treeloom.llm.toxicity import op2
from treeloom.llm.turns import OP13_SQL, op13
from treeloom.llm.warc import op1


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_index": op1,
        "op2_toxicity": op2,
        "op3_line_dedup": op3,
        "op4_ngram_jaccard_join": op4,
        "op5_best_fit_packing": op5,
        "op6_language_id": op6,
        "op7_licence_scan": op7,
        "op8_media_columns": op8,
        "op9_source_mixing": op9,
        "op10_quality_rules": op10,
        "op11_infill": op11,
        "op12_simhash": op12,
        "op13_prefix_trie": op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": OP3_SQL,
        "op9_source_mixing": OP9_SQL,
        "op11_infill": OP11_SQL,
        "op13_prefix_trie": OP13_SQL,
    }
