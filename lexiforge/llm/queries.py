"""Queries of this subpackage, and SQL for those that SQL can express."""

from .bpe import op7_bpe
from .collocations import SQL as COLLOCATION_SQL
from .collocations import op11_collocations
from .embeddings import op8_embed_dedup
from .fingerprint import op9_fingerprint
from .jaccard import op6_jaccard
from .lm import op2_lm_score
from .packing import op4_pack
from .pieces import op13_sentencepiece
from .pii import op1_pii
from .search import SQL as SEARCH_SQL
from .search import op12_search
from .sql import FINGERPRINT, JACCARD, SUBSTRING
from .substring import op10_substring
from .toxicity import op5_toxicity
from .urls import SQL as URL_SQL
from .urls import op3_url_filter

QUERIES = {
    "op1_pii": op1_pii,
    "op2_lm_score": op2_lm_score,
    "op3_url_filter": op3_url_filter,
    "op4_pack": op4_pack,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard": op6_jaccard,
    "op7_bpe": op7_bpe,
    "op8_embed_dedup": op8_embed_dedup,
    "op9_fingerprint": op9_fingerprint,
    "op10_substring": op10_substring,
    "op11_collocations": op11_collocations,
    "op12_search": op12_search,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLE: dict[str, str] = {"op3_url_filter": URL_SQL, "op6_jaccard": JACCARD, "op9_fingerprint": FINGERPRINT, "op10_substring": SUBSTRING, "op11_collocations": COLLOCATION_SQL, "op12_search": SEARCH_SQL}
