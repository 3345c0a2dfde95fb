"""The catalogue's operators, as DataFrame -> DataFrame functions."""
