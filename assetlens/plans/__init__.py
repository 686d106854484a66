"""Plan building blocks: distributed ranking and shared asset-grain summaries."""
