"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .conversation_repair import OP12_SQL, op12_conversation_repair
from .decontamination import op3_decontamination
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .itemsets import OP13_SQL, op13_itemsets
from .jaccard_join import OP5_SQL, op5_jaccard_join
from .language_id import op7_language_id
from .lm_scoring import op9_lm_score
from .mixing import op8_mix
from .piece_codec import op11_sentencepiece
from .sharding import op6_shard
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .token_counts import op4_token_counts
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_shard": op6_shard,
    "op7_language_id": op7_language_id,
    "op8_mix": op8_mix,
    "op9_lm_score": op9_lm_score,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_itemsets": op13_itemsets,
}
ORACLES = {
    "op2_substring_dedup": OP2_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_itemsets": OP13_SQL,
}
