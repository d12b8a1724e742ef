"""The queries by name, and SQL that gives the same rows."""

from __future__ import annotations

from . import artifacts, assembled, graph, large, lexical, verifier

QUERIES: dict = {**lexical.QUERIES, **graph.QUERIES, **assembled.QUERIES, **verifier.QUERIES, **artifacts.QUERIES, **large.QUERIES}
ORACLES: dict[str, str] = {**lexical.ORACLES, **graph.ORACLES, **assembled.ORACLES, **verifier.ORACLES, **artifacts.ORACLES, **large.ORACLES}
