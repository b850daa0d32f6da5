"""Sources and sinks: record tables, ground truth, match lists, checkpoints."""
