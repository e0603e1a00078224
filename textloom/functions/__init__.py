"""Column functions: folding, offsets, citations and formatting, all inside whole-stage code."""
