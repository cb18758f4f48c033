"""Queries of the corpus operators, by name, and their SQL where SQL can express them."""

from quillon.llm.op01_lm import op1_lm_score
from quillon.llm.op02_order_minhash import op2_order_minhash
from quillon.llm.op03_exact_dedup import OP3_SQL, op3_exact_dedup
from quillon.llm.op04_mixing import OP4_SQL, op4_mixing
from quillon.llm.op05_line_dedup import OP5_SQL, op5_line_dedup
from quillon.llm.op06_license import op6_license_scan
from quillon.llm.op07_bpe import op7_bpe
from quillon.llm.op08_simhash import op8_simhash
from quillon.llm.op09_toxicity import op9_toxicity
from quillon.llm.op10_pii import op10_pii

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_order_minhash": op2_order_minhash,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
}
ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op4_mixing": OP4_SQL, "op5_line_dedup": OP5_SQL}
