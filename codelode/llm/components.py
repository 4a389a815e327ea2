"""Connected components, which the engine has as well."""

from codelode.operators.components import components

__all__ = ["components"]
