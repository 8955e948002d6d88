"""Readers, writers and extraction of repositories and document tables."""
