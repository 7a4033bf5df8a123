"""Dietary-signal analytics on Spark: search, menus, inspections, catalog and operations."""

__version__ = "0.1.0"
