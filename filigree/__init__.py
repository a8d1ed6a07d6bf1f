"""filigree: graph, vector and full-text analytics as plain Spark plans."""

from filigree.session import build_session, checkpoint, shared_dir

__all__ = ["build_session", "checkpoint", "shared_dir"]
__version__ = "0.1.0"
