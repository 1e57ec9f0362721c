"""Sources: supplied tables, derived fixture tables, journal and sample files."""
