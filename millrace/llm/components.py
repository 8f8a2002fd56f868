"""Connected components of an edge table, by alternating large-star and small-star rewriting."""

from ..operators.alike import connected_components  # noqa: F401
