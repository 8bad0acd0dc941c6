"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewire.llm import chat, decontaminate, infill, licences, neardup, quality, resample, suffixdup, urls, vectordup, warc
from tidewire.llm.chat import op2_chat_formatting
from tidewire.llm.decontaminate import op5_decontamination
from tidewire.llm.infill import op13_fill_in_middle
from tidewire.llm.langid import op9_language_id
from tidewire.llm.licences import op4_license_scan
from tidewire.llm.mixing import op7_mixing
from tidewire.llm.neardup import op3_minhash_near_dedup
from tidewire.llm.quality import op6_quality_rules
from tidewire.llm.resample import op12_importance_resampling
from tidewire.llm.suffixdup import op1_suffix_array_dedup
from tidewire.llm.urls import op8_url_filter, planted_url_rules
from tidewire.llm.vectordup import op11_embedding_near_dedup
from tidewire.llm.warc import op10_warc

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_embedding_near_dedup": op11_embedding_near_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_fill_in_middle": op13_fill_in_middle,
    "planted_url_rules": planted_url_rules,
}

#: SQL for DuckDB; op7 and op9 are fitted models, which SQL doesn't express: they are tested against brute force.
ORACLES: dict[str, str] = {
    "op1_suffix_array_dedup": suffixdup.ORACLE_SQL,
    "op2_chat_formatting": chat.ORACLE_SQL,
    "op3_minhash_near_dedup": neardup.ORACLE_SQL,
    "op4_license_scan": licences.ORACLE_SQL,
    "op5_decontamination": decontaminate.ORACLE_SQL,
    "op6_quality_rules": quality.ORACLE_SQL,
    "op8_url_filter": urls.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
    "op11_embedding_near_dedup": vectordup.ORACLE_SQL,
    "op12_importance_resampling": resample.ORACLE_SQL,
    "op13_fill_in_middle": infill.ORACLE_SQL,
    "planted_url_rules": urls.PLANTED_SQL,
}
