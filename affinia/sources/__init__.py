"""Tables in versioned folders, recorded answers of other systems, and pages."""
