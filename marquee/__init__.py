"""Listings consensus, agenda queries and user-state merges as Spark DataFrame plans."""
