"""Registered queries on the driver tables, each with its SQL."""
