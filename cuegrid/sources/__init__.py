"""Readers and writers of subtitle files and track documents."""
