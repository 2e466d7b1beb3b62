"""Every operator as a query over the driver's tables, next to an independent SQL form."""

from quillon.suite import alerts, calls, corpus, intake, names, retrieval, streams  # noqa: F401
from quillon.suite.base import REGISTRY

__all__ = ["REGISTRY"]
