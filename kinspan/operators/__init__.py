"""operators of kinspan."""
