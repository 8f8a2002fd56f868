"""Operations of a large-scale training-data pipeline: one module per operation, queries in ``queries``.

Nothing outside this subpackage imports it.
"""
