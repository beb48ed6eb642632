"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from leakloom.llm.decontam import OP1_SQL, op1_benchmark_hits
from leakloom.llm.flac import op4_flac_media
from leakloom.llm.langid import op9_crf_language
from leakloom.llm.minhash import OP5_SQL, op5_minhash_components
from leakloom.llm.packing import op3_best_fit_packing
from leakloom.llm.periods import OP13_SQL, op13_periodic_runs
from leakloom.llm.secrets import op6_markov_secrets
from leakloom.llm.sharding import OP10_SQL, op10_feistel_sharding
from leakloom.llm.substrings import OP7_SQL, op7_substring_dedup
from leakloom.llm.tokens import op2_token_counts
from leakloom.llm.toxicity import op8_weak_toxicity
from leakloom.llm.trie import OP12_SQL, op12_conversation_trie
from leakloom.llm.vafile import OP11_SQL, op11_vafile_topk

QUERIES = {q.__name__: q for q in (op1_benchmark_hits, op2_token_counts, op3_best_fit_packing, op4_flac_media, op5_minhash_components, op6_markov_secrets, op7_substring_dedup, op8_weak_toxicity, op9_crf_language, op10_feistel_sharding, op11_vafile_topk, op12_conversation_trie, op13_periodic_runs)}
SQL = {"op1_benchmark_hits": OP1_SQL, "op5_minhash_components": OP5_SQL, "op7_substring_dedup": OP7_SQL, "op10_feistel_sharding": OP10_SQL, "op11_vafile_topk": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_periodic_runs": OP13_SQL}
