"""The catalogue of queries with the SQL that checks them."""
