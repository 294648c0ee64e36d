"""All registered queries."""

from __future__ import annotations

from tallyframe.plans import councils, files, logs, preparation, reports, requests, streams, texts
from tallyframe.plans.registry import QUERIES

MODULES = (texts, preparation, requests, councils, reports, files, streams, logs)

__all__ = ["MODULES", "QUERIES"]
