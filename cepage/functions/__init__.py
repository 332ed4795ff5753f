"""cepage.functions."""
