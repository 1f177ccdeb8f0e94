"""Reading and writing observations, worlds, sources and pages."""
