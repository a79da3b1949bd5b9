"""Tables, files and fixed lookups the reports read."""
