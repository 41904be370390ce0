"""Operators for preparing training data. Nothing else in the library imports this subpackage.

Each operator has a module of its own with a general interface, and one ``opN`` function that
applies it, with production parameters, to the whole of its table.
"""

from __future__ import annotations


def queries() -> dict:
    from . import ann, chat, codes, language_id, main_text, media, merkle, mixing, ngram_join, pieces, pii, url_filters, warc

    return {
        "op1_language_id": language_id.op1,
        "op2_pii": pii.op2,
        "op3_warc": warc.op3,
        "op4_main_text": main_text.op4,
        "op5_ngram_join": ngram_join.op5,
        "op6_ann": ann.op6,
        "op7_mixing": mixing.op7,
        "op8_media": media.op8,
        "op9_url_filters": url_filters.op9,
        "op10_sentencepiece": pieces.op10,
        "op11_merkle": merkle.op11,
        "op12_codes": codes.op12,
        "op13_chat": chat.op13,
    }


def oracle_sql() -> dict[str, str]:
    from . import chat, codes, merkle, url_filters, warc

    return {"op3_warc": warc.op3_sql(), "op9_url_filters": url_filters.op9_sql(), "op11_merkle": merkle.op11_sql(), "op12_codes": codes.op12_sql(), "op13_chat": chat.op13_sql()}
