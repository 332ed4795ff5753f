"""cepage.streaming."""
