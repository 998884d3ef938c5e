"""codeweave: code-graph analytics as Spark DataFrame operators."""

from .session import cut_lineage, ensure_checkpoint_dir, local_session
from .sources.tables import CodeGraph, ENTITY_SCHEMAS

__all__ = ["CodeGraph", "ENTITY_SCHEMAS", "cut_lineage", "ensure_checkpoint_dir",
           "local_session"]
