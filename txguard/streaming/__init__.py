"""Structured Streaming jobs: stateful scoring consumer and ingress pipeline."""
