"""Readers and writers of bug/fix corpora."""
