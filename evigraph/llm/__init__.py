"""Operators for training text: language, one form of equal-looking text, names, sentences, tokens, packing and splitting."""
