"""Training-data operators: ten independent operators over documents, pages and embeddings.

Nothing outside this subpackage imports it. `registry` maps query names to callables and oracle SQL.
"""
