"""Training-data operators: deduplication, tokens, language, language models, search, secrets and mixing.

Nothing outside this subpackage imports it.
"""
