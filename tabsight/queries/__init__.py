"""The engine's queries over the driver's tables, with the same questions as SQL."""
