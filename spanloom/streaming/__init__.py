"""Left empty on purpose: the feature set is batch only (no watermark, event time or state)."""
