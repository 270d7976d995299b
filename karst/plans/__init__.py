"""Query front ends: filter documents, builders, where strings, derived names."""
