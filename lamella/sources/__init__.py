"""Readers and writers: codecs, block containers, directory scans, text tables."""
