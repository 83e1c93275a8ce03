"""Relational, diff and graph operators over snapshot tables."""
