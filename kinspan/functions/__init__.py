"""functions of kinspan."""
