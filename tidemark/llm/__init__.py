"""Operators for preparing text corpora, one module each.

Nothing else in the library imports this subpackage.  Every module holds
the general operator and the thin registered query that applies it to its
whole table.
"""

from . import (  # noqa: F401 - importing a module registers its query
    byte_bpe,
    decontaminate,
    lexical,
    license_scan,
    merkle,
    minhash,
    quality,
    repeats,
    reply_trees,
    shards,
    suffix_tree,
    token_counts,
    wrappers,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
