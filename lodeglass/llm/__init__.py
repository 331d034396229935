"""Operators for training data made from the index: nothing outside this subpackage imports it."""
