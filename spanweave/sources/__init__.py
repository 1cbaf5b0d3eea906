"""Readers, writers and the logical tables built from them."""
