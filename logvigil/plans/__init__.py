"""Composed investigations, the driver-table adapter and the query registry."""
