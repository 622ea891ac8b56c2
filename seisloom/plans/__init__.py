"""Query catalogue over the driver tables, and its SQL."""
