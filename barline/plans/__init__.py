"""Plans of the daily-bar library."""
