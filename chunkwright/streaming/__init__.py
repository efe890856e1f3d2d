"""No stream operator: every job this engine covers is a batch job over complete tables."""
