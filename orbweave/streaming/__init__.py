"""Rules over unbounded streams."""
