"""Column-expression builders (P1-P23): pure ``Column -> Column`` helpers."""
