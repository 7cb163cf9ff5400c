"""Operators on vintaged forecasts and outturns, each a lazy DataFrame plan."""
