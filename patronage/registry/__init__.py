"""Registered queries over the star-schema tables, and the SQL they are checked against."""
