"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from .op1_toxicity import toxicity
from .op10_license_scan import license_scan
from .op11_alignment import cross_alignment
from .op12_mixing import mix
from .op13_hard_negatives import SQL as NEGATIVES_SQL
from .op13_hard_negatives import hard_negatives
from .op2_minhash_dedup import SQL as NEAR_SQL
from .op2_minhash_dedup import near_components
from .op3_training_order import training_order
from .op4_decontamination import decontaminate
from .op5_chat_format import SQL as CHAT_SQL
from .op5_chat_format import chat_format
from .op6_suffix_dedup import SQL as REPEATS_SQL
from .op6_suffix_dedup import suffix_dedup
from .op7_token_counts import token_counts
from .op8_exact_topk import SQL as TOPK_SQL
from .op8_exact_topk import exact_topk
from .op9_packing import pack
from .store import table


def op1_toxicity(spark, sf_dir):
    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_dedup(spark, sf_dir):
    return near_components(spark, table(spark, sf_dir, "documents"))


def op3_training_order(spark, sf_dir):
    return training_order(spark, table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat_format(spark, sf_dir):
    return chat_format(spark, table(spark, sf_dir, "conversations"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup(spark, table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark, sf_dir):
    return exact_topk(spark, table(spark, sf_dir, "embeddings"))


def op9_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op10_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def op11_alignment(spark, sf_dir):
    return cross_alignment(spark, table(spark, sf_dir, "documents"))


def op12_mixing(spark, sf_dir):
    return mix(spark, table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_minhash_dedup, op3_training_order, op4_decontamination, op5_chat_format, op6_suffix_dedup, op7_token_counts, op8_exact_topk, op9_packing, op10_license_scan, op11_alignment, op12_mixing, op13_hard_negatives)
}
# The others have no SQL form: tests hold them to brute force, exact round trips or held-out accuracy.
ORACLE_SQL = {"op2_minhash_dedup": NEAR_SQL, "op5_chat_format": CHAT_SQL, "op6_suffix_dedup": REPEATS_SQL, "op8_exact_topk": TOPK_SQL, "op13_hard_negatives": NEGATIVES_SQL}
