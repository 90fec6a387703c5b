"""Adoption analytics over stored snapshots of code repositories, on Spark."""

from usemeter.config import Caps, Thresholds, UsageSpec, Weights

__all__ = ["Caps", "Thresholds", "UsageSpec", "Weights"]
