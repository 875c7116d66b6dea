"""Readers, and marked-up test documents built from plain tables."""
