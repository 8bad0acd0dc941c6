"""Stand-in relations, queries and their SQL."""
