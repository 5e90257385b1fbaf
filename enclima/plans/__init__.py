"""End-to-end compositions and the named query catalogue over the driver tables."""

from .registry import ORACLES, QUERIES


def load_all():
    """Import every query module so that its queries register."""
    from . import q_reshape, q_climate, q_sources, q_frames, q_models, q_flows, q_stream, q_files  # noqa: F401
    return QUERIES, ORACLES
