"""DataFrame operators: descriptors, profiles, splits, balance, metrics, experiments."""
