"""Column helpers: rounding, ratios, bands, calendar names and the named business metrics."""
