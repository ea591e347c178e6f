"""plans of the lattice library."""
