"""Operators for training data: names, matches, groups, containers, mixtures and text quality."""
