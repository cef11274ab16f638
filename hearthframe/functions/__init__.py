"""Column functions: text, scalars and planar geometry, all native expressions unless said otherwise."""
