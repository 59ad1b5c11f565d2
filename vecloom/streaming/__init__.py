"""No operator: the engine's surface has no data streams, so none are offered here."""
