"""Scalar column functions: vectors, angles, rounding, names and time of day."""

from canopia.functions.names import run_name, tree_number
from canopia.functions.rounding import by_magnitude, clean
from canopia.functions.vectors import angle_deg, axis_distance, dot, norm, orthonormal, rotation_matrix

__all__ = ["angle_deg", "axis_distance", "by_magnitude", "clean", "dot", "norm", "orthonormal", "rotation_matrix", "run_name", "tree_number"]
