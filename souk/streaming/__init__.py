"""Structured Streaming entry points for the stateless survey checks.

The reference works on whole files; the checks that look at one interview at
a time (duration, outliers against fixed column statistics) also run as a
stream over interviews as they arrive.
"""
