"""Every operator as a named query over the driver tables, with the same question as SQL where SQL can ask it."""

from threadscope.catalog import (  # noqa: F401
    describing, evaluating, labelling, learning, reporting, sampling, sources, streaming, tagging, texts, timing,
)
from threadscope.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
