"""Registered queries over the trade tables, and the SQL each must agree with."""
