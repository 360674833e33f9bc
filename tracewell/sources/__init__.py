"""sources of the transfer-graph engine."""
