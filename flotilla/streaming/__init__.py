"""Structured Streaming jobs: incremental ingest and fatigue alerts."""
