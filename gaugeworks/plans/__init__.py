"""Named queries with their SQL equivalents."""
