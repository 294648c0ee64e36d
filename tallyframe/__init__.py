"""Language-model evaluation analytics as Spark DataFrame operators."""

from tallyframe.session import build_session

__all__ = ["build_session"]
