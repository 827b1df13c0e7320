"""Registered queries: operators applied to tables, each with the SQL that has to give the same rows."""
