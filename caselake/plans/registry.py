"""Registered queries over the driver tables and their SQL."""

from __future__ import annotations

from . import derived, relational, retrieval, texts

QUERIES = {**texts.QUERIES, **derived.QUERIES, **relational.QUERIES, **retrieval.QUERIES}
ORACLES = {**texts.ORACLES, **derived.ORACLES, **relational.ORACLES, **retrieval.ORACLES}
