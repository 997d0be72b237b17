"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ionweave.llm import codes, jaccard, licenses, linededup, nearcopies, topk, turns
from ionweave.llm.bpe import op6_bpe
from ionweave.llm.codes import op11_codes
from ionweave.llm.jaccard import op4_jaccard
from ionweave.llm.licenses import op8_licenses
from ionweave.llm.linededup import op9_line_dedup
from ionweave.llm.nearcopies import op12_near_copies
from ionweave.llm.packing import op5_packing
from ionweave.llm.pii import op2_pii
from ionweave.llm.quality import op7_fertility
from ionweave.llm.topk import op1_topk
from ionweave.llm.toxicity import op10_toxicity
from ionweave.llm.turns import op13_turns
from ionweave.llm.urls import op3_urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_topk, op2_pii, op3_urls, op4_jaccard, op5_packing, op6_bpe, op7_fertility, op8_licenses, op9_line_dedup, op10_toxicity,
        op11_codes, op12_near_copies, op13_turns,
    )
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {
        "op1_topk": topk.ORACLE,
        "op4_jaccard": jaccard.ORACLE,
        "op8_licenses": licenses.ORACLE,
        "op9_line_dedup": linededup.ORACLE,
        "op11_codes": codes.ORACLE,
        "op12_near_copies": nearcopies.ORACLE,
        "op13_turns": turns.ORACLE,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in found.items() if sql}
