"""Table operators: curves, clustering measures, features, running values and lookups."""
