"""The queries of the training-data operators, and SQL where it can express them."""

import corpus_pipeline

from . import mixing, prefixtrie, repair
from .bytebpe import op11_byte_bpe
from .html import op10_html
from .jaccard import op1_jaccard_join
from .mixing import op6_mixing
from .nearest import op8_nearest
from .pieces import op3_pieces
from .prefixtrie import op13_trie
from .quality import op7_quality
from .repair import op12_repair
from .sharding import op4_sharding
from .substring import op5_substring
from .tokenfiles import op9_token_counts
from .toxicity import op2_toxicity

QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_toxicity, op3_pieces, op4_sharding, op5_substring, op6_mixing, op7_quality, op8_nearest, op9_token_counts, op10_html, op11_byte_bpe, op12_repair, op13_trie)}
QUERIES["pipeline"] = corpus_pipeline.run

SQL: dict[str, str] = {"op6_mixing": mixing.SQL, "op12_repair": repair.SQL, "op13_trie": prefixtrie.SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
