"""Nothing here: the engine is batch only, as its blueprint has no stream, state or watermark."""
