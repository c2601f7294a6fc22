"""Sources: framed text files, records, tables, JSON posts and generated rows."""
