"""Query front ends and fixpoints."""
