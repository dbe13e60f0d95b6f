"""Readers, cleaning, targets, table writers and artifacts."""
