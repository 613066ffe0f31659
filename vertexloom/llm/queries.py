"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from vertexloom.llm.ann import op5_nearest
from vertexloom.llm.chat import OP3_SQL, op3_chat_format
from vertexloom.llm.decontaminate import OP1_SQL, op1_decontaminate
from vertexloom.llm.jaccard import OP8_SQL, op8_jaccard_join
from vertexloom.llm.licenses import op2_license_scan
from vertexloom.llm.linededup import op10_line_dedup
from vertexloom.llm.packing import op6_packing
from vertexloom.llm.pii import op7_pseudonyms
from vertexloom.llm.toxicity import op4_toxicity
from vertexloom.llm.urlfilter import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_license_scan": op2_license_scan,
    "op3_chat_format": op3_chat_format,
    "op4_toxicity": op4_toxicity,
    "op5_nearest": op5_nearest,
    "op6_packing": op6_packing,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_url_filter": op9_url_filter,
    "op10_line_dedup": op10_line_dedup,
}
ORACLES = {"op1_decontaminate": OP1_SQL, "op3_chat_format": OP3_SQL, "op8_jaccard_join": OP8_SQL, "op9_url_filter": OP9_SQL}
