"""Every report as a named query over the test tables, and the same in plain SQL."""
