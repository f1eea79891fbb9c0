"""No streaming operators.

The inventory this package implements has no watermarks, event time or late
data: every input is a finished table, and the zero-phase notch filter is
non-causal, so it cannot run on an open stream.
"""
