"""Sources of raw product rows and pages."""
