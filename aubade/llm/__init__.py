"""Operators for training data: nearest times, top items, one look of a text, name variants, packing, mixing, spam pages."""
