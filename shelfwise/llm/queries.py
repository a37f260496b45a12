"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from shelfwise.llm.fill_middle import OP13_SQL, op13_fill_middle
from shelfwise.llm.katz import op7_lm_score
from shelfwise.llm.media_chunks import op2_media_chunks
from shelfwise.llm.mixing import OP9_SQL, op9_source_mix
from shelfwise.llm.near_dedup import op3_near_dedup
from shelfwise.llm.packing import op6_best_fit_packing
from shelfwise.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from shelfwise.llm.quality_rules import op8_quality_rules
from shelfwise.llm.repeated_windows import OP11_SQL, op11_substring_dedup
from shelfwise.llm.secret_scan import op4_secret_scan
from shelfwise.llm.token_files import op1_token_files
from shelfwise.llm.toxicity import op5_toxicity
from shelfwise.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_media_chunks,
        op3_near_dedup,
        op4_secret_scan,
        op5_toxicity,
        op6_best_fit_packing,
        op7_lm_score,
        op8_quality_rules,
        op9_source_mix,
        op10_warc,
        op11_substring_dedup,
        op12_prefix_trie,
        op13_fill_middle,
    )
}

ORACLE_SQL: dict[str, str] = {"op9_source_mix": OP9_SQL, "op10_warc": OP10_SQL, "op11_substring_dedup": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_fill_middle": OP13_SQL}
