"""Reading, checking and generating vintaged tables."""
