"""Where records go. See the README."""
