"""Inputs that the named queries derive from the data folder's tables."""
