"""termweave: text and term-graph analytics as plain DataFrame functions."""
