"""Text safety and instruction data as Spark DataFrame operators."""

from parapet.config import GuardConfig

__all__ = ["GuardConfig"]
