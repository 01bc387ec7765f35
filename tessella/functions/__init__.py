"""Column functions: normalization, tokenizers, text transforms and statistics."""
