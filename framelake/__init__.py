"""Bus-log analytics on Spark: sources, decoding, alignment, condition machines, diagnostics."""
