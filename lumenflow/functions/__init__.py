"""Column expressions."""

from . import scalars, vectors

__all__ = ["scalars", "vectors"]
