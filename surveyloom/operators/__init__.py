"""DataFrame operators, all usable through ``DataFrame.transform``."""
