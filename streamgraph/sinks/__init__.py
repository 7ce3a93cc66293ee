"""Sinks: guarded JSON, injected clients, database upserts, dead letters."""
