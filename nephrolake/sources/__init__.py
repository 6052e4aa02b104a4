"""Sources, sinks and the layers of tables."""
