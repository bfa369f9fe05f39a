"""Connected components, which the core has."""

from factloom.operators.components import components

__all__ = ["components"]
