"""Readers and writers of tables, seeds, files and pages."""
