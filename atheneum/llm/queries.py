"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from atheneum.llm.chat_format import OP3_SQL, op3_chat_format
from atheneum.llm.decontaminate import OP10_SQL, op10_decontaminate
from atheneum.llm.divergence import OP12_SQL, op12_divergence
from atheneum.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from atheneum.llm.katz import op2_katz
from atheneum.llm.language_id import op4_language_id
from atheneum.llm.line_dedup import op5_line_dedup
from atheneum.llm.mixing import op9_mixing
from atheneum.llm.resampling import OP11_SQL, op11_resample
from atheneum.llm.sharding import op6_sharding
from atheneum.llm.simhash import op8_simhash
from atheneum.llm.substring_dedup import op7_substring_dedup
from atheneum.llm.toxicity import op13_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_katz, op3_chat_format, op4_language_id, op5_line_dedup,
        op6_sharding, op7_substring_dedup, op8_simhash, op9_mixing, op10_decontaminate,
        op11_resample, op12_divergence, op13_toxicity,
    )
}

SQL = {"op1_exact_dedup": OP1_SQL, "op3_chat_format": OP3_SQL, "op10_decontaminate": OP10_SQL, "op11_resample": OP11_SQL, "op12_divergence": OP12_SQL}
