"""Query catalogue: engine plans and their independent SQL oracles."""
