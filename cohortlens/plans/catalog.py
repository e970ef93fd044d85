"""Import every query module so that REGISTRY is complete."""

from . import q_core, q_features, q_io, q_metrics, q_misc, q_ml, q_pipeline, q_prep, q_profile  # noqa: F401
from .registry import REGISTRY  # noqa: F401
