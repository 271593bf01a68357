"""Training-data operators: one module per operator, ``queries`` wires them to the driver tables."""
