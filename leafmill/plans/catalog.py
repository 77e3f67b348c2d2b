"""All core queries by name, with their SQL."""

from __future__ import annotations

from leafmill.plans import answers, chunks, scalars, search, trees  # noqa: F401
from leafmill.plans.base import QUERIES, SQL  # noqa: F401
