"""Registered queries of the training-data operators."""
from __future__ import annotations

from . import (bottomk, chat, decontam, filter_audit, html_text, mixing, parity_join, phrases, pii, quality,
               sharding, toxicity, warc)

QUERIES = {
    "op1_fm_decontam": decontam.query,
    "op2_chat_format": chat.query,
    "op3_toxicity_ssk": toxicity.query,
    "op4_pii_boosted": pii.query,
    "op5_quality_nbsvm": quality.query,
    "op6_parity_join": parity_join.query,
    "op7_host_path_text": html_text.query,
    "op8_bottomk_fingerprint": bottomk.query,
    "op9_warc_chain": warc.query,
    "op10_fair_queue_mix": mixing.query,
    "op11_stratified_shards": sharding.query,
    "op12_posting_audit": filter_audit.query,
    "op13_dynamic_collocations": phrases.query,
}

# the others are not expressible in SQL and are tested against brute force
ORACLE = {
    "op1_fm_decontam": decontam.SQL,
    "op2_chat_format": chat.SQL,
    "op9_warc_chain": warc.SQL,
    "op10_fair_queue_mix": mixing.SQL,
    "op12_posting_audit": filter_audit.SQL,
    "op13_dynamic_collocations": phrases.SQL,
}
