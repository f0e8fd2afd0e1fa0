"""Column helpers: scalar expressions and per-entity history windows."""
