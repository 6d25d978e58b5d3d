"""Table schemas, stored tables, file sinks and the mapping of the test tables."""
