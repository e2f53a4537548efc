"""The training loop and whole jobs."""
