"""Operators for preparing training text: cleaning, scoring, joining and sharding documents."""
