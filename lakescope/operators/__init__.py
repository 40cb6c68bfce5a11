"""Relational operators, each DataFrame or Column to DataFrame or Column, keyed by table_id."""
