"""Connected components; the library's own star steps."""

from toolframe.operators.components import components

__all__ = ["components"]
