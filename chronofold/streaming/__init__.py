"""Structured Streaming: pairing, running totals, closing, de-duplication, late corrections."""
