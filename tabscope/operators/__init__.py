"""The analyses. Every operator takes a DataFrame and returns a DataFrame."""
