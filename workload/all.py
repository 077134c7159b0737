from workload import columns, distributions, learning, merging, sources, splits, statistics  # noqa: F401
