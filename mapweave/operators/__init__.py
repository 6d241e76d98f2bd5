"""Registration, binding, stitching, relations and features."""
