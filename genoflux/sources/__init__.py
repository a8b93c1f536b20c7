"""Readers and writers of variant, sequence, map and table formats."""
