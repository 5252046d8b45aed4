"""Connected components of a table of edges."""

from __future__ import annotations

from ..operators.components import roots as components  # noqa: F401
