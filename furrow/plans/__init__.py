"""Planning on the driver: classification, dependency graphs and generation plans."""
