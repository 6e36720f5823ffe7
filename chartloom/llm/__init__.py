"""Operators for training data: names, personal information, matching, survivors, tokens, leaks and sentences."""
