"""All registered queries of the library and their SQL."""

from __future__ import annotations

from fieldglass.plans import q_fields, q_joins, q_lists, q_records, q_reports, q_sources, q_streams, q_tracks, q_windows

_PARTS = (q_fields, q_lists, q_joins, q_reports, q_records, q_windows, q_sources, q_streams, q_tracks)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: text for part in _PARTS for name, text in part.ORACLES.items()}
