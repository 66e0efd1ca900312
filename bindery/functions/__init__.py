"""Archive dataflow: functions."""
