"""Reusable DataFrame steps the reports are composed of."""
