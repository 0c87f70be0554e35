"""Every query of the library: name -> (query, its SQL or None)."""

from __future__ import annotations

from leafmill.operators import archives, editor, flow, placement, relational, render, tables

QUERIES = flow.QUERIES | relational.QUERIES | placement.QUERIES | render.QUERIES | tables.QUERIES | archives.QUERIES | editor.QUERIES
