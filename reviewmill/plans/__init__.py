"""Job and report plans over the review tables."""
