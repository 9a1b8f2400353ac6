"""Plans: recipes, the registered driver queries and their DuckDB oracles."""
