"""All queries of this subpackage; importing the modules registers them."""

from __future__ import annotations

from binweave.llm import (  # noqa: F401
    bitplanes,
    decontaminate,
    jaccard,
    language,
    lexical,
    lm,
    neighbours,
    packing,
    quality,
    resampling,
    sharding,
    substrings,
    topk,
)
from binweave.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
