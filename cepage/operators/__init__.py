"""cepage.operators."""
