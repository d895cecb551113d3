"""Registered queries of the operators in this subpackage, and their SQL where SQL can tell them."""

from __future__ import annotations

from roadsky.llm.crf_quality import op4_quality
from roadsky.llm.decontaminate import OP6_SQL, op6_decontaminate
from roadsky.llm.filter_audit import OP11_SQL, op11_filter_audit
from roadsky.llm.html_text import op8_html
from roadsky.llm.packing import op13_packing
from roadsky.llm.pieces import op7_sentencepiece
from roadsky.llm.runlength import op5_runlength
from roadsky.llm.secrets import op2_secrets
from roadsky.llm.simhash import op3_simhash
from roadsky.llm.spelling import OP12_SQL, op12_spelling
from roadsky.llm.toxicity import op10_toxicity
from roadsky.llm.vantage import op9_vantage
from roadsky.llm.warc import OP1_SQL, op1_warc

LLM_QUERIES = {
    "op1_warc": op1_warc,
    "op2_secrets": op2_secrets,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_runlength": op5_runlength,
    "op6_decontaminate": op6_decontaminate,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_html": op8_html,
    "op9_vantage": op9_vantage,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling": op12_spelling,
    "op13_packing": op13_packing,
}

LLM_ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op6_decontaminate": OP6_SQL, "op11_filter_audit": OP11_SQL, "op12_spelling": OP12_SQL}
