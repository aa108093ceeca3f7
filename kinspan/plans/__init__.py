"""plans of kinspan."""
