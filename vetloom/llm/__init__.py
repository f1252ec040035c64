"""Operators for training data made of text and vectors; nothing outside this subpackage imports it."""
