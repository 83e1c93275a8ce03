"""Readers and writers of snapshots, reports, manifests and caches."""
