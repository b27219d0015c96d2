"""Tracewell: provenance analytics for AI-agent event streams, on Spark."""
