"""Chunked output for a viewer that loads only what is selected."""
