"""Readers, writers and the settings-keyed cache."""
