"""All queries of the subpackage and their SQL."""

from threadscope.llm import collocations, decontaminate, hard_negatives, html_main, licenses, line_dedup, packing, secrets, sharding, simhash, suffix_dedup, topk, toxicity  # noqa: F401
from threadscope.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
