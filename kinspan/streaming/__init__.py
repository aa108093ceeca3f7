"""streaming of kinspan."""
