"""Readers, writers and stored-table updates."""
