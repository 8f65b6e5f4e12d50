"""Pattern functions: canonical codes, extensions, orbits and text forms (plain Python; patterns have a handful of vertices)."""

from graphmine.functions.pattern import ANY, IN, OUT, Code, Edge, canonical_code, extensions, is_canonical, orbits

__all__ = ["ANY", "IN", "OUT", "Code", "Edge", "canonical_code", "extensions", "is_canonical", "orbits"]
