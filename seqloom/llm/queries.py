"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .binary_records import op9_records
from .media import op4_media
from .jaccard_join import op8_jaccard_join
from .mixing import OP5_SQL, op5_mix
from .neighbours import op7_neighbours
from .packing import op1_pack
from .quotations import OP2_SQL, op2_quotations
from .suffix_tree import op10_suffix_tree
from .toxicity import op6_toxicity
from .url_filter import OP3_SQL, op3_url_filter

QUERIES = {
    "op1_pack": op1_pack,
    "op2_quotations": op2_quotations,
    "op3_url_filter": op3_url_filter,
    "op4_media": op4_media,
    "op5_mix": op5_mix,
    "op6_toxicity": op6_toxicity,
    "op7_neighbours": op7_neighbours,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_records": op9_records,
    "op10_suffix_tree": op10_suffix_tree,
}
SQL = {"op2_quotations": OP2_SQL, "op3_url_filter": OP3_SQL, "op5_mix": OP5_SQL}
