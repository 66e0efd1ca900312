"""Archive dataflow: streaming."""
