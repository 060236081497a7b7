"""Reports, panels and maintenance jobs composed from the operators."""
