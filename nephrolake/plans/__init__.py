"""Plans over whole layers, and the registered queries."""
