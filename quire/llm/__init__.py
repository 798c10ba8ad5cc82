"""Operators that prepare a training corpus: one module per operator."""
