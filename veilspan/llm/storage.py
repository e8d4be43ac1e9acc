"""Intermediate tables in the shared folder, whose shuffles go once the table stands."""

from __future__ import annotations

from veilspan.session import written

__all__ = ["written"]
