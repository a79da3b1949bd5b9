"""The reports. Each takes summary frames (``operators.summary``) and returns a DataFrame."""
