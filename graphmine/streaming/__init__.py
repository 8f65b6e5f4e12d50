"""Graphs that grow: the search repeated over a stream of edges."""

from graphmine.streaming.incremental import mine_stream

__all__ = ["mine_stream"]
