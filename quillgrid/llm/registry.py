"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from quillgrid.llm import decontamination, filter_audit, merkle, secrets, sharding
from quillgrid.llm.language import op11_language
from quillgrid.llm.media_jpeg import op2_media
from quillgrid.llm.quality import op6_quality
from quillgrid.llm.sentencepiece_agenda import op7_sentencepiece
from quillgrid.llm.simhash import op4_simhash
from quillgrid.llm.suffixes import op10_suffixes
from quillgrid.llm.token_files import op1_token_files
from quillgrid.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_media": op2_media,
    "op3_sharding": sharding.op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_quality": op6_quality,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_secrets": secrets.op9_secrets,
    "op10_suffixes": op10_suffixes,
    "op11_language": op11_language,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op3_sharding": sharding.oracle_sql(),
    "op5_decontamination": decontamination.oracle_sql(),
    "op9_secrets": secrets.oracle_sql(),
    "op12_filter_audit": filter_audit.oracle_sql(),
    "op13_merkle_manifest": merkle.oracle_sql(),
}
