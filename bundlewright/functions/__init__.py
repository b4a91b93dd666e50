"""Column functions of the engine."""

from bundlewright.functions.paths import NODE_KINDS, extension, glob_match, is_denied, language_of, path_parts
from bundlewright.functions.signatures import jaccard_estimate, minhash
from bundlewright.functions.text import (
    classify_query,
    is_relevant,
    lines_of,
    token_estimate,
    tokens,
    trigram_jaccard,
    trigrams,
    truncate,
    unique_tokens,
)

__all__ = [
    "NODE_KINDS",
    "classify_query",
    "extension",
    "glob_match",
    "is_denied",
    "is_relevant",
    "jaccard_estimate",
    "language_of",
    "lines_of",
    "minhash",
    "path_parts",
    "token_estimate",
    "tokens",
    "trigram_jaccard",
    "trigrams",
    "truncate",
    "unique_tokens",
]
