"""Throughput as a stream, and screening of arriving data."""
