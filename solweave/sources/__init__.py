"""Stores, importers and step files."""
