"""The SQL front end and the catalogue of queries."""
