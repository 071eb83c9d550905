"""Reusable DataFrame operators the reports are composed of."""
