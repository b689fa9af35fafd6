"""Generic job lowering, partitioners and the named workloads."""
