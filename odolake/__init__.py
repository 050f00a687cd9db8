"""Vehicle telemetry analytics as DataFrame transformations."""
