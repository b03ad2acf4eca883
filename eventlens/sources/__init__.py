"""Scans (JSON arrays, JSON Lines, CSV, result folders, landed news pages, prices,
macro series) and sinks (JSON Lines, CSV, landing, per-model results)."""
