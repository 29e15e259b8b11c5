"""Operators for preparing training text: language, near copies, personal data, packing and scoring."""
