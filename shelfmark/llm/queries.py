"""Queries of this subpackage by name, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard_join, secrets
from .decontamination import op3_containment_search
from .jaccard_join import op9_jaccard_join
from .packing import op1_harmonic_packing
from .pii import op8_pii_deobfuscation
from .quality_mil import op6_attention_quality
from .quality_rules import op10_quality_rules
from .secrets import op2_secret_scan
from .toxicity import op5_compression_toxicity
from .url_filter import op4_url_templates
from .warc import op7_warc_derivatives


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_harmonic_packing, op2_secret_scan, op3_containment_search, op4_url_templates, op5_compression_toxicity, op6_attention_quality, op7_warc_derivatives, op8_pii_deobfuscation, op9_jaccard_join, op10_quality_rules)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": secrets.ORACLE, "op3_containment_search": decontamination.ORACLE, "op9_jaccard_join": jaccard_join.ORACLE}
