"""The operators' registered queries and the SQL that checks those that SQL can express."""

from __future__ import annotations

from tidewater.llm import alignment, chat, codes, html, jaccard, mixing, neighbours, packing, pii, quality, sketches, transport, urls

QUERIES = {
    "op1_chat_formatting": chat.query,
    "op2_packing": packing.query,
    "op3_url_filters": urls.query,
    "op4_quality_classifier": quality.query,
    "op5_html_extraction": html.query,
    "op6_ngram_jaccard_join": jaccard.query,
    "op7_pii": pii.query,
    "op8_embedding_near_dedup": neighbours.query,
    "op9_media_columns": transport.query,
    "op10_mixing": mixing.query,
    "op11_vector_codes": codes.query,
    "op12_document_fingerprints": sketches.query,
    "op13_cross_tokenizer_alignment": alignment.query,
}
ORACLES = {"op1_chat_formatting": chat.SQL, "op3_url_filters": urls.oracle(), "op10_mixing": mixing.SQL, "op12_document_fingerprints": sketches.SQL}
