"""Stand-in tables, registered queries and their oracles."""
