"""Bring messy tables into existing tables with Spark: read, profile, map, check, repair, merge."""
