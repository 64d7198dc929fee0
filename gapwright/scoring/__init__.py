"""scoring of the engine."""
