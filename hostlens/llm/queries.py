"""All queries of the subpackage."""

from hostlens.llm import (  # noqa: F401
    chat, language_model, metric_tree, mixing, pieces, quality_model, quality_rules, sharding, simhash, source_audit,
    token_alignment, token_counts, warc,
)
from hostlens.llm.common import REGISTRY

__all__ = ["REGISTRY"]
