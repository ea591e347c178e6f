"""functions of the lattice library."""
