"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from groupwise.llm.ann import op9_ann
from groupwise.llm.bpe import op7_bpe
from groupwise.llm.chat import op3_chat_format
from groupwise.llm.jaccard import op2_jaccard_join
from groupwise.llm.lines import OP5_SQL, op5_line_dedup
from groupwise.llm.media import op8_media
from groupwise.llm.packing import op1_packing
from groupwise.llm.quality import op6_quality
from groupwise.llm.secrets import op4_secrets
from groupwise.llm.simhash import op12_simhash
from groupwise.llm.trie import OP13_SQL, op13_prefix_trie
from groupwise.llm.warc import op10_warc
from groupwise.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_packing, op2_jaccard_join, op3_chat_format, op4_secrets, op5_line_dedup, op6_quality, op7_bpe, op8_media, op9_ann, op10_warc, op11_whitening, op12_simhash, op13_prefix_trie)}
#: The others need a tokenizer, a fitted model, archives or ordered digests, and are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op13_prefix_trie": OP13_SQL}
