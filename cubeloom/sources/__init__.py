"""Readers and writers of the annotation formats."""
