"""Plans: label notations for queries, batch runs, driver queries with their SQL."""
