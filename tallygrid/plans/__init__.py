"""Ready-made catalogues and the registered workloads."""
