"""Readers and the operators that shape their output before any line is looked at."""
