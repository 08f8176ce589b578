"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quillsieve.llm import changes, chat, decontaminate, filters, html_text, lines, mixing, pii, secrets, simhash, sketch, topk, toxicity

QUERIES = {
    "op1_line_dedup": lines.op1,
    "op2_chat": chat.op2,
    "op3_simhash": simhash.op3,
    "op4_toxicity": toxicity.op4,
    "op5_pii": pii.op5,
    "op6_secrets": secrets.op6,
    "op7_decontamination": decontaminate.op7,
    "op8_html": html_text.op8,
    "op9_topk": topk.op9,
    "op10_mixing": mixing.op10,
    "op11_setsketch": sketch.op11,
    "op12_changes": changes.op12,
    "op13_filter_audit": filters.op13,
}

SQL = {
    "op7_decontamination": decontaminate.SQL,
    "op9_topk": topk.SQL,
    "op10_mixing": mixing.SQL,
    "op11_setsketch": sketch.SQL,
    "op13_filter_audit": filters.SQL,
}
