"""The registered queries of the operators and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from tunesift.llm.alignment import op12_align_dictionaries
from tunesift.llm.divergence import OP11_SQL, op11_divergence_quadtree
from tunesift.llm.fingerprint import op3_fingerprint_quartile
from tunesift.llm.langid import op4_language_viterbi
from tunesift.llm.lm import op10_lm_elias_fano
from tunesift.llm.mixing import op9_mix_sainte_lague
from tunesift.llm.nndescent import OP5_SQL, op5_embedding_nn_descent
from tunesift.llm.packing import op6_pack_bin_completion
from tunesift.llm.sharding import op2_shard_hilbert
from tunesift.llm.simhash import op1_simhash_near_dup
from tunesift.llm.toxicity import op8_toxicity_kneser_ney
from tunesift.llm.urlfilter import OP13_SQL, op13_url_rarest_token
from tunesift.llm.warc import OP7_SQL, op7_warc_normalise

QUERIES = {
    "op1_simhash_near_dup": op1_simhash_near_dup,
    "op2_shard_hilbert": op2_shard_hilbert,
    "op3_fingerprint_quartile": op3_fingerprint_quartile,
    "op4_language_viterbi": op4_language_viterbi,
    "op5_embedding_nn_descent": op5_embedding_nn_descent,
    "op6_pack_bin_completion": op6_pack_bin_completion,
    "op7_warc_normalise": op7_warc_normalise,
    "op8_toxicity_kneser_ney": op8_toxicity_kneser_ney,
    "op9_mix_sainte_lague": op9_mix_sainte_lague,
    "op10_lm_elias_fano": op10_lm_elias_fano,
    "op11_divergence_quadtree": op11_divergence_quadtree,
    "op12_align_dictionaries": op12_align_dictionaries,
    "op13_url_rarest_token": op13_url_rarest_token,
}

ORACLES: dict[str, str] = {
    "op5_embedding_nn_descent": OP5_SQL,
    "op7_warc_normalise": OP7_SQL,
    "op11_divergence_quadtree": OP11_SQL,
    "op13_url_rarest_token": OP13_SQL,
}
