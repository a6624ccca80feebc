"""Readers, writers and the content-addressed cache."""
