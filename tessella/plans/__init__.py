"""The catalogue of registered queries, their inputs and the SQL that says the same."""
