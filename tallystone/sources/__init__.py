"""Readers, writers and record generators."""
