"""Readers and writers of sequencing and annotation files."""
