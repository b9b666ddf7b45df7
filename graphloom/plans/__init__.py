"""Plan helpers: fixpoints and the catalogue of queries with their SQL."""
