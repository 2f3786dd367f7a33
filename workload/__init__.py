"""The registered queries: claim logs derived from the given tables, the queries over
them, and the SQL each is checked against."""
