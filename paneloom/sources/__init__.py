"""Readers, writers and the adapters that give driver tables the shape of a panel."""
