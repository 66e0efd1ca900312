"""Archive dataflow: sources."""
