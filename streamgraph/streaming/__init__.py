"""Stateful streaming operators and monitoring."""
