"""Files, saved models and stored metric series."""
