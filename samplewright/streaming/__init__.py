"""The same moments and metrics, kept up to date on streams."""
