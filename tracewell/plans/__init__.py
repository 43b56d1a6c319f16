"""Query registry over the driver tables, and the views that feed it."""
