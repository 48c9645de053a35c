"""Queries made of the operators, and the SQL that they are held against."""
