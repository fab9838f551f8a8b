"""Where collections come from and where commits go."""
