"""DataFrame operators on workflow, run, configuration and log tables."""
