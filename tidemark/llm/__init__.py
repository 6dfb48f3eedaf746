"""Operators for preparing training data: nearest-time matching, tokenizing, mixing, look-alike texts. Optional."""
