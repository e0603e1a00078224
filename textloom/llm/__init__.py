"""Operators that prepare text at corpus scale for training language models; nothing else in the library imports them."""
