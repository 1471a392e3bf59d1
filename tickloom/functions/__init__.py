"""Scalar functions of the engine, as Catalyst expressions."""
