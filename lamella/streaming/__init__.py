"""Streaming counterparts, an extension beyond the batch operators."""
