"""The immutable query builder and its compilation to a DataFrame."""
