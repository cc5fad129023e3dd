"""Operators for preparing training text: dedup, scans, extraction, packing, output."""
