"""JSON functions and functions written in the dialect."""
