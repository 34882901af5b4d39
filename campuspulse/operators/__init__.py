"""DataFrame operators, grouped by the grain they work on."""
