"""Training-data operators; nothing else in kinspan imports this subpackage."""
