"""Registered queries, one module per operator family."""
