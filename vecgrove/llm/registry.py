"""Queries of this subpackage and their SQL, by name."""

from vecgrove.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from vecgrove.llm.html_text import op1_html_text
from vecgrove.llm.line_quality import op2_line_quality
from vecgrove.llm.mixing import op5_mix
from vecgrove.llm.packing import op8_pack
from vecgrove.llm.pii import op10_pii
from vecgrove.llm.simhash import op9_simhash
from vecgrove.llm.toxicity import op3_toxicity
from vecgrove.llm.url_filter import OP6_SQL, op6_url_filter
from vecgrove.llm.weak_quality import op7_weak_quality

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_text,
        op2_line_quality,
        op3_toxicity,
        op4_exact_dedup,
        op5_mix,
        op6_url_filter,
        op7_weak_quality,
        op8_pack,
        op9_simhash,
        op10_pii,
    )
}
ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op6_url_filter": OP6_SQL}
