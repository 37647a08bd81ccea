"""Plans: the index engine and the registered queries."""
