"""Column-level helpers and the fixed metric catalogue."""
