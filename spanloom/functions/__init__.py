"""Column expressions: text, identifiers, paths, links and classification."""
