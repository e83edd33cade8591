"""Plans: bindings of the driver tables to operator inputs, and the query catalog."""
