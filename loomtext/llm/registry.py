"""Names and SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import chats, contamination, languages, licenses, packing, perplexity, rules, simhash, substrings, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        rules.op1_rules,
        simhash.op2_simhash,
        languages.op3_languages,
        perplexity.op4_quality,
        licenses.op5_licences,
        contamination.op6_decontamination,
        chats.op7_chats,
        packing.op8_packing,
        substrings.op9_substrings,
        toxicity.op10_toxicity,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return rules.SQL | contamination.SQL | chats.SQL | substrings.SQL
