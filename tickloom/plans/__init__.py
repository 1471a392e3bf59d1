"""Declarations that compile to DataFrame plans: parameters, predicates, strategies, screens and tiers."""
