"""sources of the lattice library."""
