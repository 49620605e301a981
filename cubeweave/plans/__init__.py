"""Whole queries: the compressor and the registered catalogue."""
