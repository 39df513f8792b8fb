"""pageflow: a PySpark-native engine for page-level document recognition results."""

from pageflow.session import checkpointed, ensure_checkpoint_dir, load_table

__all__ = ["checkpointed", "ensure_checkpoint_dir", "load_table"]
