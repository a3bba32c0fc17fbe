"""The catalogue of reports and the session they run in."""
