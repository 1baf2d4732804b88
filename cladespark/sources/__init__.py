"""Readers and writers of sequence, distance and tree text."""
