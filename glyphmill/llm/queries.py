"""Queries of this subpackage with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from glyphmill.llm.decontamination import OP1_SQL, op1
from glyphmill.llm.embedding_dedup import OP6_SQL, op6
from glyphmill.llm.hard_negatives import OP12_SQL, op12
from glyphmill.llm.lexical_search import OP13_SQL, op13
from glyphmill.llm.license_scan import op10
from glyphmill.llm.mixing import op7
from glyphmill.llm.ngram_join import OP3_SQL, op3
from glyphmill.llm.quality import op8
from glyphmill.llm.sharding import op11
from glyphmill.llm.substring_dedup import op5
from glyphmill.llm.token_store import op2
from glyphmill.llm.url_filter import op4
from glyphmill.llm.warc_convert import op9

QUERIES = {
    "op1_decontamination": op1,
    "op2_token_store": op2,
    "op3_ngram_join": op3,
    "op4_url_filter": op4,
    "op5_substring_dedup": op5,
    "op6_embedding_dedup": op6,
    "op7_mixing": op7,
    "op8_quality": op8,
    "op9_warc": op9,
    "op10_license_scan": op10,
    "op11_sharding": op11,
    "op12_hard_negatives": op12,
    "op13_lexical_search": op13,
}
ORACLE_SQL = {"op1_decontamination": OP1_SQL, "op3_ngram_join": OP3_SQL, "op6_embedding_dedup": OP6_SQL, "op12_hard_negatives": OP12_SQL, "op13_lexical_search": OP13_SQL}
