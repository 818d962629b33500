"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from larkspur.llm import bpe, chat, chunks, mixing, neardup, quality, rollup, substrings, urls, warc


def queries():
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_chunk_fingerprints": chunks.op2_chunk_fingerprints,
        "op3_substring_dedup": substrings.op3_substring_dedup,
        "op4_token_rollups": rollup.op4_token_rollups,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_warc_reader": warc.op6_warc_reader,
        "op7_url_filters": urls.op7_url_filters,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_near_dedup": neardup.op9_near_dedup,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql():
    return {
        "op4_token_rollups": rollup.SQL,
        "op5_chat_formatting": chat.SQL,
        "op6_warc_reader": warc.SQL,
        "op7_url_filters": urls.SQL,
        "op10_mixing": mixing.SQL,
    }
