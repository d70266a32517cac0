"""tapeline: market time-series research as Spark DataFrame operators."""

from tapeline.session import chunk_rows, ensure_checkpoint_dir, local_session

__all__ = ["chunk_rows", "ensure_checkpoint_dir", "local_session"]
