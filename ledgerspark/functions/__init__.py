"""Column functions: money, calendar, text and identity."""
