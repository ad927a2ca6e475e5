"""Stand-in views over the driver tables and the registry of named queries."""
