"""Column builders: pure expressions, no DataFrame is touched here."""
