"""sources of kinspan."""
