"""operators of the lattice library."""
