"""Queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from ordinate.llm.ann import op1_ann
from ordinate.llm.decontam import OP7_SQL, op7_decontamination
from ordinate.llm.html import op8_html
from ordinate.llm.langid import op4_language_id
from ordinate.llm.mixing import OP5_SQL, op5_mixing
from ordinate.llm.quality import op3_quality
from ordinate.llm.secrets import op2_secrets
from ordinate.llm.simhash import op9_simhash
from ordinate.llm.toxicity import op10_toxicity
from ordinate.llm.urls import op6_urls

QUERIES = {f.__name__: f for f in (op1_ann, op2_secrets, op3_quality, op4_language_id, op5_mixing, op6_urls, op7_decontamination, op8_html, op9_simhash, op10_toxicity)}
SQL = {"op5_mixing": OP5_SQL, "op7_decontamination": OP7_SQL}
