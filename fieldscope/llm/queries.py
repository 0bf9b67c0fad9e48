"""The operators of this package as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from fieldscope.llm import chat, extraction, merkle, minhash, mixing, packing, quality, sharding, spelling, suffixes, tokens, warc, winnowing


def all_queries():
    built = [warc.op1_warc_bundles, winnowing.op2_winnowing, packing.op3_length_buckets, mixing.op4_mixture, quality.op5_quality_cascade,
             extraction.op6_template_removal, tokens.op7_token_files, suffixes.op8_suffix_repeats, minhash.op9_minhash, sharding.op10_extendible_sharding,
             spelling.op11_spelling_groups, chat.op12_chat_format, merkle.op13_merkle_manifest]
    return {f.__name__: f for f in built}


def all_oracles():
    return {"op1_warc_bundles": warc.WARC_SQL, "op5_quality_cascade": quality.QUALITY_SQL,
            "op9_minhash": minhash.NEAR_SQL, "op10_extendible_sharding": sharding.sharding_sql(),
            "op11_spelling_groups": spelling.SPELLING_SQL, "op12_chat_format": chat.CHAT_SQL, "op13_merkle_manifest": merkle.MERKLE_SQL}
