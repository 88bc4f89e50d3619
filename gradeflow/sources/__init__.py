"""Sources, sinks and settings."""
