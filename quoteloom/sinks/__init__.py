"""Tables that are written to."""
