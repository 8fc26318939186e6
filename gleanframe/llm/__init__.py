"""Operators for training data: groups, subsets, neighbours, clusters, tokens, packing and text quality."""

QUERY_MODULES = ("groups", "varied", "similar", "clusters", "encoding", "containers", "prose")
