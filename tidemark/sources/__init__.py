"""Source catalog, run log and payload-to-item jobs."""
