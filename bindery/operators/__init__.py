"""Archive dataflow: operators."""
