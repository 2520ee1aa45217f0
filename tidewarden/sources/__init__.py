"""Readers and writers for portfolio tables, documents and extracted facts."""
