"""Registered queries and the plans that they share."""
