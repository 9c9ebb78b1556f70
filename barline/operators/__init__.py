"""Operators of the daily-bar library."""
