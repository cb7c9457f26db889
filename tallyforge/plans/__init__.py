"""Queries that bind the operators to tables, each with SQL that checks it where SQL can express it."""
