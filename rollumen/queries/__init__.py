"""Registered queries by family; each module has QUERIES and ORACLE_SQL under the same names."""
