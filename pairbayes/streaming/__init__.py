"""Structured Streaming: score a stream with a frozen model (ST1) and
refresh cell counts additively (ST2)."""
