"""Archive dataflow: plans."""
