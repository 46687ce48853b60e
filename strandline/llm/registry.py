"""The subpackage's queries and their DuckDB counterparts."""

from __future__ import annotations

from . import codes, langid, line_dedup, media, mixing, near_dedup, pieces, prefix_join, secrets, spelling, talks, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_sentencepiece": pieces.op1_sentencepiece,
        "op2_media": media.op2_media,
        "media_pages": media.media_pages,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_secrets": secrets.op5_secrets,
        "op6_mixing": mixing.op6_mixing,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_topk_codes": codes.op8_topk_codes,
        "op9_language_id": langid.op9_language_id,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_conversation_repair": talks.op11_conversation_repair,
        "op12_ngram_join": prefix_join.op12_ngram_join,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": url_filter.OP3_SQL,
        "op5_secrets": secrets.OP5_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op7_line_dedup": line_dedup.OP7_SQL,
        "op8_topk_codes": codes.OP8_SQL,
        "op10_near_dedup": near_dedup.OP10_SQL,
        "op11_conversation_repair": talks.OP11_SQL,
        "op12_ngram_join": prefix_join.OP12_SQL,
        "op13_spelling_variants": spelling.OP13_SQL,
    }
