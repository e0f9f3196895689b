"""All queries of this folder, and their DuckDB SQL where SQL can say them."""

from sparkrec.llm import q_ann, q_bpe, q_decontam, q_html, q_langid, q_lexical, q_lm, q_packing, q_secrets, q_simhash, q_tokenfile, q_urlfilter, q_whiten

_MODULES = (q_langid, q_html, q_ann, q_simhash, q_packing, q_tokenfile, q_urlfilter, q_lm, q_decontam, q_secrets, q_bpe, q_lexical, q_whiten)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
