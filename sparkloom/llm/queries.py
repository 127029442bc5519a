"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op6_byte_bpe
from .decontaminate import OP8_SQL, op8_decontaminate
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .exact_search import OP12_SQL, op12_exact_search
from .html_text import op3_html_extract
from .join_view import OP11_SQL, op11_join_view
from .langid import op5_language_id
from .prefix_trie import op13_prefix_trie
from .quality import op7_quality
from .secrets import op1_secret_scan
from .simhash import op9_simhash_near_dedup
from .substring_dedup import OP10_SQL, op10_substring_dedup
from .token_pack import op4_token_pack

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_html_extract": op3_html_extract,
    "op4_token_pack": op4_token_pack,
    "op5_language_id": op5_language_id,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_join_view": op11_join_view,
    "op12_exact_search": op12_exact_search,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op8_decontaminate": OP8_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_join_view": OP11_SQL,
    "op12_exact_search": OP12_SQL,
}
