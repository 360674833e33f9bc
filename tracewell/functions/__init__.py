"""functions of the transfer-graph engine."""
