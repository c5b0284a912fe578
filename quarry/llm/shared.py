"""What several operators use: words, and the library's tables that cut lineage and connected components."""

from __future__ import annotations

from quarry.operators.tables import components, cut, partitions, shared_dir

__all__ = ["GAP", "WORD", "components", "cut", "partitions", "shared_dir"]

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
