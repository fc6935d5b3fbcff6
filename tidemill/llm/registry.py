"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from tidemill.llm import contracts
from tidemill.llm.decontaminate import op3_decontamination
from tidemill.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from tidemill.llm.jaccard_join import op4_jaccard_join
from tidemill.llm.language_id import op10_language_id
from tidemill.llm.line_dedup import OP7_SQL, op7_line_dedup
from tidemill.llm.mixing import op9_mixing
from tidemill.llm.oracles import OP3_SQL, OP4_SQL, OP5_SQL
from tidemill.llm.sharding import op8_sharding
from tidemill.llm.substring_dedup import op5_substring_dedup
from tidemill.llm.token_counts import op2_token_counts
from tidemill.llm.url_filter import op6_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_token_counts, op3_decontamination, op4_jaccard_join, op5_substring_dedup,
        op6_url_filter, op7_line_dedup, op8_sharding, op9_mixing, op10_language_id,
    )
}

ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op3_decontamination": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op7_line_dedup": OP7_SQL}
QUERIES |= contracts.QUERIES
ORACLE_SQL |= contracts.SQL
