"""plans of the transfer-graph engine."""
