"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from plumbline.llm.bpe import op10_bpe
from plumbline.llm.decontamination import OP8_SQL, op8_decontamination
from plumbline.llm.jaccard_join import op3_jaccard_join
from plumbline.llm.license_scan import op4_license_scan
from plumbline.llm.quality import op7_quality
from plumbline.llm.secret_scan import op2_secret_scan
from plumbline.llm.substring_dedup import op6_substring_dedup
from plumbline.llm.topk import OP5_SQL, op5_topk
from plumbline.llm.toxicity import op9_toxicity
from plumbline.llm.warc import OP1_SQL, op1_warc

QUERIES: dict[str, Callable] = {
    "op1_warc": op1_warc,
    "op2_secret_scan": op2_secret_scan,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_license_scan": op4_license_scan,
    "op5_topk": op5_topk,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
}
ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op5_topk": OP5_SQL,
    "op8_decontamination": OP8_SQL,
}


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
