"""Running forms of batch plans."""
