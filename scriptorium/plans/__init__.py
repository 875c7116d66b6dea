"""Plan-level helpers: sessions and scratch tables."""
