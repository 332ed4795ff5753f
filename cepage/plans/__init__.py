"""cepage.plans."""
