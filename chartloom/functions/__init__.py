"""chartloom subpackage."""
