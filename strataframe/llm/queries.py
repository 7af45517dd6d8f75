"""Queries of this subpackage, and their SQL where it exists."""

from __future__ import annotations

from strataframe.llm import ann, fim, importance, mixing
from strataframe.llm.ann import op1_near_vectors
from strataframe.llm.bpe import op2_bpe
from strataframe.llm.chat import op8_chats
from strataframe.llm.fim import op11_fim
from strataframe.llm.importance import op12_importance
from strataframe.llm.mixing import op6_mix
from strataframe.llm.quality import op9_quality
from strataframe.llm.sharding import op10_shard
from strataframe.llm.simhash import op7_simhash
from strataframe.llm.spans import op4_spans
from strataframe.llm.spotsigs import op3_spotsigs
from strataframe.llm.token_counts import op13_token_counts
from strataframe.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_near_vectors": op1_near_vectors,
    "op2_bpe": op2_bpe,
    "op3_spotsigs": op3_spotsigs,
    "op4_spans": op4_spans,
    "op5_toxicity": op5_toxicity,
    "op6_mix": op6_mix,
    "op7_simhash": op7_simhash,
    "op8_chats": op8_chats,
    "op9_quality": op9_quality,
    "op10_shard": op10_shard,
    "op11_fim": op11_fim,
    "op12_importance": op12_importance,
    "op13_token_counts": op13_token_counts,
}
SQL: dict[str, str] = {"op1_near_vectors": ann.SQL, "op6_mix": mixing.SQL, "op11_fim": fim.SQL, "op12_importance": importance.SQL}
