"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from .kdshards import op2
from .lattice import op7
from .licenses import OP1_SQL, op1
from .ngram_join import op9
from .packing import op4
from .quality import op10
from .toxicity import op6
from .transducer import op5
from .varbyte import op8
from .winnow import op3

QUERIES = {
    "op1_license_scan": op1,
    "op2_kd_shards": op2,
    "op3_winnowing": op3,
    "op4_best_fit_packing": op4,
    "op5_token_counts": op5,
    "op6_toxicity": op6,
    "op7_lattice_score": op7,
    "op8_varbyte_ids": op8,
    "op9_ngram_join": op9,
    "op10_quality_rules": op10,
}
SQL = {"op1_license_scan": OP1_SQL}
