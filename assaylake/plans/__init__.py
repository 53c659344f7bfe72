"""Whole runs: extract to events, and events to layers."""
