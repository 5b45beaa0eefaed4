"""The package of the engine."""
