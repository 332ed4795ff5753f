"""cepage.sources."""
