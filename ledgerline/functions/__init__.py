"""Column expressions: row text, keys, hashes, padding, masks and tokens."""
