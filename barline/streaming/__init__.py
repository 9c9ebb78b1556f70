"""Streaming of the daily-bar library."""
