"""Named queries over the engine's tables."""
