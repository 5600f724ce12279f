"""Where fields come from and where runs write."""

from .output import OutputFile, get_versions
from .session import make_session, quiet
from .tables import embedding_lattice, event_lattice

__all__ = ["OutputFile", "embedding_lattice", "event_lattice", "get_versions", "make_session", "quiet"]
