"""Votes that arrive over time; everything else of the library is batch."""
