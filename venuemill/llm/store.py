"""Tables written to the shared folder, to cut lineage and compute a thing once."""

from __future__ import annotations

from venuemill.session import stored

__all__ = ["stored"]
