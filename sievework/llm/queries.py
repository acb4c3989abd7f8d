"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from . import chat, fingerprints, firstfit, langid, packing, periodic, sentencepiece, sharding, simhash, suffixes, vafile, warc, whitening

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_warc": warc.op2_warc,
    "op3_simhash": simhash.op3_simhash,
    "op4_top_k": vafile.op4_top_k,
    "op5_language_id": langid.op5_language_id,
    "op6_sentencepiece": sentencepiece.op6_sentencepiece,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_packing": packing.op9_packing,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_whitening": whitening.op11_whitening,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_packing": firstfit.op13_packing,
}

ORACLE_SQL = {
    "op2_warc": warc.OP2_SQL,
    "op4_top_k": vafile.OP4_SQL,
    "op10_chat_formatting": chat.OP10_SQL,
}
