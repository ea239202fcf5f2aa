"""Scalar column functions; each one stays inside whole-stage codegen."""
