"""Registered queries over the bundled tables, and independent SQL for them."""
