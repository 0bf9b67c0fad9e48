"""Reports and whole sweeps composed from the operators."""
