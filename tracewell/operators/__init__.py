"""operators of the transfer-graph engine."""
