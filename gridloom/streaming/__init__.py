"""streaming of the lattice library."""
