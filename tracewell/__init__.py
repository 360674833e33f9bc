"""Forensic transfer-graph analytics written as Spark DataFrame plans."""
