"""Registered queries and the end-to-end report plan."""
