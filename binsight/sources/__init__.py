"""Sources and sinks: image files, JSON item feeds, the item table, driver tables."""
