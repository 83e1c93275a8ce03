"""Composed plans: compilation of snapshots into reports, packets and writing plans."""
