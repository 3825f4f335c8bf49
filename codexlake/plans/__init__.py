"""Registered queries: operators applied to the driver's tables, and their SQL."""
